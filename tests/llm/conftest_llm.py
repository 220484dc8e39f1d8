import random
import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


#: Null id, null and empty texts, ties, repeated rows, odd white space, many bytes, one very long text.
EDGES = [
    (None, None), (None, "alone in here"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"),
    (6, "naïve café 中文 🙂 x y"), (7, "A B c d E f g h i j k l m n o p"), (8, "a b C D e f g h i j k l m n o p"),
    (9, prose(1, 30_000)), (10, "\x1c \x0bq\x0c r\r\ns"), (11, "z " * 40), (12, "z " * 40),
]
