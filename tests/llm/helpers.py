"""Small tables and plain-Python versions to hold operators against."""

import random
import re

LETTERS = ["ka", "lo", "mi", "ne", "ru", "sto", "va", "pe"]


def lower(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def prose(rng, n):
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed=0, n=60):
    """(doc_id, text): prose with exact and near copies, shared passages, odd texts and nulls."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(n)]
    passage = prose(rng, 40)
    for k in range(0, n, 7):
        texts.append(texts[k])
        texts.append(texts[k].upper())
        w = texts[k].split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append("  ".join(v))
    texts += [f"{passage} {t}" for t in texts[:6]]
    texts += [None, "", " \t\n", "one", "one two", "ONE  two", "É é", "é É", "x" * 5000, "  a b", passage, prose(rng, 3000)]
    rows = list(enumerate(texts))
    rows += [rows[3], rows[3], (None, texts[2]), (None, None)]
    rng.shuffle(rows)
    return rows


def documents(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # columns of other operators' names
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(7).alias(c) for c in ("h", "key", "n", "label", "score", "keep_id", "component", "chunk", "at", "size", "held_out", "_tokens_")), F.lit("en").alias("lang"), F.lit("src").alias("source"), F.lit(1).alias("n_chars"))
    return df
