"""Topic evolution over dated text corpora, as DataFrame-to-DataFrame functions on Spark."""
