import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]


def make_docs(spark, texts, extra=False):
    """Documents of texts; ids leave gaps, so order isn't place."""
    rows = [(3 * k + 1, t, ["en", "fr", None][k % 3], ["s0", "s1", None][k % 3], len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        for c in ("component_id", "size", "block", "key", "tokens", "a", "h"):
            df = df.selectExpr("*", f"'x' as {c}")
    return df


def prose(n, seed=0, vocabulary=400):
    r = random.Random(seed)
    known = ["".join(r.choice("abcdeiortu") for _ in range(r.randint(1, 9))) for _ in range(vocabulary)]
    return " ".join(r.choice(known) for _ in range(n))


ODD = [None, "", " \n\t", "a", "A b", "ß é ñ 日本 😀", "x" * 5000, "the " * 900, "one two three", "one two three", "ONE  two\tthree"]
