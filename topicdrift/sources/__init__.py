from .pages import PAGE_SCHEMA, ingest, read_pages, revisions, subset

__all__ = ["PAGE_SCHEMA", "ingest", "read_pages", "revisions", "subset"]
