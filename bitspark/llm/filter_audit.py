"""Interaction audit of document filters.

Which filter gets a removal depends on the order in which filters run.  A document fails a set of filters,
its mask, and filters that run in any order remove the documents of the masks that meet them.  With x_i the
chance that filter i runs, the expected number of removals is the multilinear extension of that game,

    f(x) = sum over masks m of n_m (1 - product over i in m of (1 - x_i)),

a polynomial with whole coefficients that the mask counts fix.  Its corners are the removals of every set of
filters, hence the survivors after every step of every order; the integral of its partial derivative along the
diagonal is a filter's Shapley value, an exact rational that the number of orders makes whole.

Spark makes the masks and counts them for each part; a part's polynomial has at most 2^k terms.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitspark.llm.quality import let, text_words

LETTERS = "ABCDE"
MOST = 8  # filters: 40,320 orders of eight rows for each part
SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


class Removals:
    """The removal polynomial of mask counts: coefficients of its multilinear terms, by the mask of their variables."""

    def __init__(self, terms: dict[int, int]):
        self.terms = terms

    @classmethod
    def of(cls, counts: Iterable[tuple[int, int]]) -> Removals:
        """From ``(mask, documents)``: 1 - product of (1 - x_i) has the coefficient 1 or -1 at every part of the mask."""
        terms: dict[int, int] = {}
        for mask, n in counts:
            part = mask
            while part:
                terms[part] = terms.get(part, 0) + (n if part.bit_count() % 2 else -n)
                part = (part - 1) & mask
        return cls(terms)

    def corner(self, chosen: int) -> int:
        """Documents that the filters of ``chosen`` remove together."""
        return sum(c for part, c in self.terms.items() if part & ~chosen == 0)

    def partial(self, i: int) -> Removals:
        """The derivative by x_i, again multilinear."""
        return Removals({part ^ (1 << i): c for part, c in self.terms.items() if part >> i & 1})

    def along_diagonal(self) -> Fraction:
        """Integral of f(t, ..., t) for t from 0 to 1."""
        return sum((Fraction(c, part.bit_count() + 1) for part, c in self.terms.items()), Fraction(0))

    def shapley(self, i: int) -> Fraction:
        return self.partial(i).along_diagonal()


def orders_of(counts: list[tuple[int, int, int, int]], letters: str) -> Iterator[tuple]:
    """Rows ``order, step, kept, ...`` of all orders from ``(mask, documents, good, toxic)``."""
    k = len(letters)
    every, good, toxic = (Removals.of((c[0], c[j]) for c in counts) for j in (1, 2, 3))
    total, scale, whole = sum(c[1] for c in counts), math.factorial(k), (1 << k) - 1
    at, at_good, at_toxic = ([p.corner(s) for s in range(whole + 1)] for p in (every, good, toxic))
    unique = [at[whole] - at[whole ^ 1 << i] for i in range(k)]
    values = [scale * every.shapley(i) for i in range(k)]
    for order in permutations(range(k)):
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = at[after] - at[before]
            yield name, step, total - at[after], removed, at[1 << i] - removed, unique[i], at_good[after] - at_good[before], at_toxic[after] - at_toxic[before], int(values[i])
            before = after


def all_orders(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``counts(part, mask, n, n_good, n_toxic)``, a row for each part and mask -> the rows of every order of the filters.

    Bit i of a mask is a failure of filter ``letters[i]``.  Parts are independent; each has at most
    2^k rows here.  No rows give no rows.
    """
    if not 1 <= len(set(letters)) == len(letters) <= MOST:
        raise ValueError(f"give one to {MOST} different letters")

    def audited(rows: pd.DataFrame) -> pd.DataFrame:
        found = list(zip(*(rows[c].astype(int).tolist() for c in ("mask", "n", "n_good", "n_toxic")), strict=True))
        out = pd.DataFrame(list(orders_of(found, letters)), columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
        out.insert(0, "part", rows["part"].iloc[0])
        return out

    return counts.groupBy("part").applyInPandas(audited, SCHEMA)


def text_failures(text: Column) -> Column:
    """Mask of a text that isn't null: bit 0 under 100 words, 1 few distinct words, 2 many capitals, 3 a symbol of ``#$%&*|``."""
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    words = let(text_words(text), lambda w: let(F.size(w), lambda n: F.when(n < 100, 1).otherwise(0) + F.when(F.size(F.array_distinct(w)) * 100 < n * 80, 2).otherwise(0)))
    return words + F.when(capitals * 100 > F.char_length(text) * 10, 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows(doc_id, digest, ...)`` with ``good`` and ``toxic``; an id has what any of its labels says, and false without."""
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # rows without an id meet no label; dealt by their text they don't meet each other either
    told = told.select(F.col("doc_id").alias("told_id"), F.lit(False).alias("told_none"), "good", "toxic")
    rows = rows.withColumn("none", F.col("doc_id").isNull()).withColumn("at", F.coalesce("doc_id", F.xxhash64("digest")))
    met = rows.join(told, (F.col("at") == F.col("told_id")) & (F.col("none") == F.col("told_none")), "left")
    return met.drop("at", "told_id", "told_none").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def mask_counts(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``part, mask, n, n_good, n_toxic`` of the five filters; see ``audit``.

    A copy is known by its text's SHA-256 and size.  Of each text only counts and the least id of each part
    and label go on, so that a text of very many copies is a few rows where they meet.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("part"), let(body, lambda t: F.struct(F.unhex(F.sha2(t, 256)).alias("digest"), text_failures(t).alias("mask"))).alias("s"))
    rows = with_labels(rows.select("doc_id", "part", "s.*"), labels)
    kind = ["digest", "part", "mask", "good", "toxic", "none"]
    by_id = rows.groupBy(*kind, "doc_id").agg(F.count("*").alias("n"))
    by_text = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    known = F.when(~F.col("none"), F.col("first.doc_id"))
    first = F.min(known).over(W.partitionBy("digest"))
    originals = F.when(F.col("none"), F.col("n")).when(known == F.col("least"), F.col("first.n")).otherwise(0)
    split = by_text.withColumn("least", first).withColumn("own", originals)
    sums = split.groupBy("part", "mask", "good", "toxic").agg(F.sum("own").alias("own"), F.sum(F.col("n") - F.col("own")).alias("copies"))
    both = sums.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("own").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("copies").alias("n")))).alias("c"))
    return both.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), F.sum(F.when(F.col("good"), F.col("c.n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("c.n")).otherwise(0)).alias("n_toxic"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """All 120 orders of five filters over the documents of each language: a row for each part, order and step.

    A: under 100 words; B: under four fifths of the words distinct; C: over a tenth of the code points are
    A-Z; D: holds one of ``#$%&*|``; E: equal to the text of a smaller id, in whatever part.  ``kept`` and
    ``removed`` are documents after and in the step, ``redundant`` those that fail its filter but went
    before, ``unique_fails`` those that fail it alone, ``good_lost`` and ``toxic_lost`` the labelled ones among
    the removed, and ``shapley`` the filter's removals summed over all orders.

    A null text is empty, and a null language the empty string.  A null id is never a copy and never an original of
    one; rows of one id and text are no copies of each other.  Repeated rows count as often as they are there;
    labels that repeat or differ count once.  Other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    return all_orders(mask_counts(docs, labels, **columns))


#: Counts by plain sums over every order, without the polynomial.
ORACLE = r"""
WITH f AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM f GROUP BY t),
said AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM f JOIN firsts USING (t)),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN said USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a JOIN l b ON b.bit <> a.bit JOIN l c ON c.bit NOT IN (a.bit, b.bit) JOIN l d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN l e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM o, generate_series(1, 5) AS g(step)),
r AS (
  SELECT part, filter_order, step, bit, sum(n) FILTER (mask & CAST(before + bit AS INTEGER) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & CAST(before AS INTEGER) = 0) AS removed,
    sum(n) FILTER (mask & bit > 0 AND mask & CAST(before AS INTEGER) > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
    sum(g) FILTER (mask & bit > 0 AND mask & CAST(before AS INTEGER) = 0) AS good_lost, sum(x) FILTER (mask & bit > 0 AND mask & CAST(before AS INTEGER) = 0) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
FROM r
"""
