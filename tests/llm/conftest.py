from __future__ import annotations

import random

import pytest

#: Names that the operators use inside; a table may have columns of the same names.
CLASH = ["n", "fp", "size", "rank", "cell", "key", "part", "h", "s", "start", "guest", "tie", "chunk", "row", "n_words", "kept", "levels", "distance", "slot", "shard", "digest", "first", "host", "term", "file"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    common = "the of and to in is that it for on with as was at by".split()
    word = lambda: r.choice(common) if r.random() < 0.35 else "".join(r.choice(["ba", "ko", "ri", "tu", "ne", "sha", "lor"]) for _ in range(r.randint(1, 4)))
    return " ".join(word() + ("." if r.random() < 0.08 else "") for _ in range(n))


def documents() -> list[tuple]:
    base = [prose(k, 60 + 7 * k) for k in range(24)]
    rows = [(k, t, "en" if k % 3 else "de", f"s{k % 4}") for k, t in enumerate(base)]
    words = base[5].split()
    rows += [
        (100, base[3], "en", "s0"), (101, base[3], "en", "s1"), (102, " ".join(words[:40] + ["changed"] + words[41:]), "en", "s1"), (103, base[5].upper(), None, "s2"),
        (104, "", "en", "s0"), (105, None, "en", None), (106, " \t\n ", None, None), (107, "one two", "en", "s3"), (108, "one two", "en", "s3"), (109, "three", "fr", "s3"),
        (110, "In. " * 3000, "en", "s9"), (111, prose(99, 6000), "en", "s9"), (112, "été déjà vu naïve œuvre 東京 " * 15, "fr", "ünï"), (113, "###$$$ " * 60, "en", "s0"),
        (7, base[7], "de" if 7 % 3 == 0 else "en", "s3"), (7, base[7], "de" if 7 % 3 == 0 else "en", "s3"), (None, base[9], "en", "s1"), (None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    df = df.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id = -5")
