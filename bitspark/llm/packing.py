"""Packing by optimal length buckets.

The global histogram of lengths decides: dynamic programming places a given number of bucket boundaries so
that padding every sequence to its bucket's boundary wastes least.  Inside a bucket, batches hold as many
sequences as a token budget has room for at the boundary's length.

The histogram has a row for each distinct length.  Distinct lengths add up to no more than all tokens, so
that D of them need D (D + 1) / 2 tokens or more: 10^13 tokens can't have over 4.5 million, whatever the
number of sequences.  The dynamic programme takes D steps for each bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitspark.llm.mixing import CELL_FACTOR, word_count
from bitspark.llm.permute import PRIME
from bitspark.llm.scratch import Stored


BUCKETS = 8
BUDGET = 16_384


def optimal_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Boundaries (largest lengths) of at most ``buckets`` runs of the ascending ``lengths`` with the least padding.

    The padding of a last run that begins after i and ends at j is linear in the length at j, with the number
    of sequences up to i as its slope: for each j the best i is the lowest of a family of lines, whose
    slopes fall and whose arguments rise, so that one pass over a queue of lines fills a layer.  Numbers are
    exact; of equal splits the earliest counts.
    """
    n = len(lengths)
    if not n:
        return []
    c, s = [0], [0]
    for t, k in zip(lengths, counts, strict=True):
        c.append(c[-1] + k)
        s.append(s[-1] + k * t)
    best = [t * c[j + 1] - s[j + 1] for j, t in enumerate(lengths)]
    splits = []
    for _ in range(1, min(buckets, n)):
        lines: list[tuple[int, int, int]] = []  # (sequences up to i, height, i)
        head, new, at = 0, [best[0]], [-1]
        for j in range(1, n):
            m, h = c[j], best[j - 1] + s[j]
            while len(lines) - head >= 2:
                (m1, h1, _), (m2, h2, _) = lines[-2], lines[-1]
                if (h - h1) * (m2 - m1) > (h2 - h1) * (m - m1):
                    break
                lines.pop()  # nowhere below both of its neighbours
            lines.append((m, h, j - 1))
            t = lengths[j]
            while head + 1 < len(lines) and lines[head + 1][1] - t * lines[head + 1][0] < lines[head][1] - t * lines[head][0]:
                head += 1
            m, h, i = lines[head]
            new.append(t * c[j + 1] - s[j + 1] + h - t * m)
            at.append(i)
        splits.append(at)
        best = new
    out, j = [], n - 1
    for at in reversed(splits):
        out.append(lengths[j])
        j = at[j]
        if j < 0:
            return sorted(out)
    return sorted([*out, lengths[j]])


def pack(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET,
) -> DataFrame:
    """``doc_id, length, bucket, boundary, batch, place, padding`` for every row.

    ``length`` is the tokens of a sequence, by default its words ``[^\\x20\\x09-\\x0D]+`` and one end; a
    null or blank text has length 1, and a given null or negative length counts as 0.  A bucket holds
    lengths above the previous boundary up to its own; its batches are numbered from 0 and filled in a
    pseudorandom order of ids, ``budget // boundary`` sequences each and at least one, so that a sequence
    longer than the budget has a batch of its own; rows of equal id follow each other by length.  Nothing is cut or left out: only the last batch of a
    bucket may have room left.  Repeated rows and null ids are packed like others.  Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    size = F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("bigint") if length is not None else word_count(F.col(f"`{text}`")) + 1
    rows = Stored(docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), size.alias("length")), "lengths").df
    hist = sorted((r["length"], r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect())
    edges = optimal_boundaries([h[0] for h in hist], [h[1] for h in hist], buckets)
    return fill_batches(rows, edges, budget, sum(h[1] for h in hist))


def fill_batches(rows: DataFrame, edges: list[int], budget: int, n: int) -> DataFrame:
    """Number the rows of each bucket in a pseudorandom order of ids and cut them into batches.

    A bucket is numbered in about ``sqrt(n)`` cells, each on its own, from the sums of the cells before,
    so that a bucket with a large share of all rows is no task's alone.  Null ids are dealt by their lengths.
    """
    if not edges:
        return rows.select("doc_id", "length", F.lit(0).alias("bucket"), F.lit(0).cast("bigint").alias("boundary"), F.lit(0).cast("bigint").alias("batch"), F.lit(0).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("padding"))
    bounds = F.array(*[F.lit(e).cast("bigint") for e in edges])
    bucket = F.size(F.filter(bounds, lambda e: e < F.col("length")))
    cells = max(1, math.ceil(math.sqrt(n)))
    spread = F.pmod(F.coalesce("doc_id", "length"), F.lit(PRIME)) * F.lit(CELL_FACTOR).cast("bigint") % F.lit(PRIME)
    rows = rows.withColumn("bucket", bucket).withColumn("h", spread).withColumn("cell", F.pmod("h", F.lit(cells)))
    inner = F.row_number().over(W.partitionBy("bucket", "cell").orderBy("h", "doc_id", "length"))
    sums = rows.groupBy("bucket", "cell").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("bucket").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("bucket", "cell", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("inner") - 1
    out = rows.withColumn("inner", inner).join(sums, ["bucket", "cell"]).withColumn("rank", rank).withColumn("boundary", F.get(bounds, F.col("bucket")))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1)))).cast("bigint")
    out = out.withColumn("room", room)
    return out.select(
        "doc_id", "length", "bucket", "boundary", F.floor(F.col("rank") / F.col("room")).cast("bigint").alias("batch"), (F.col("rank") % F.col("room")).cast("bigint").alias("place"), (F.col("boundary") - F.col("length")).alias("padding"),
    )


def oracle(buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The same packing as one SQL statement over ``documents``, with as many distinct lengths as buckets or more."""
    layers, edges = "b1 AS (SELECT i, t, c, s, t * c - s AS best, -1 AS split FROM h)", f"e{buckets} AS (SELECT i, t, split FROM b{buckets} ORDER BY i DESC LIMIT 1)"
    for k in range(2, buckets + 1):
        layers += f""",
b{k} AS (
  SELECT j.i, j.t, j.c, j.s, CASE WHEN p.z IS NULL THEN j.t * j.c - j.s ELSE j.t * j.c - j.s + p.z.v END AS best, CASE WHEN p.z IS NULL THEN -1 ELSE p.z.split END AS split
  FROM h j LEFT JOIN (SELECT j.i, min(struct_pack(v := p.best + p.s - j.t * p.c, split := p.i)) AS z FROM h j JOIN b{k - 1} p ON p.i < j.i GROUP BY j.i) p ON p.i = j.i)"""
    for k in range(buckets - 1, 0, -1):
        edges += f", e{k} AS (SELECT b.i, b.t, b.split FROM b{k} b JOIN e{k + 1} e ON b.i = e.split)"
    cuts = " UNION ALL ".join(f"SELECT t FROM e{k}" for k in range(1, buckets + 1))
    return rf"""
WITH rows AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS BIGINT) AS length FROM documents),
h AS (
  SELECT row_number() OVER (ORDER BY t) - 1 AS i, t, CAST(sum(n) OVER (ORDER BY t) AS BIGINT) AS c, CAST(sum(n * t) OVER (ORDER BY t) AS BIGINT) AS s
  FROM (SELECT length AS t, count(*) AS n FROM rows GROUP BY length)),
{layers},
{edges},
edges AS ({cuts}),
placed AS (
  SELECT r.doc_id, r.length, CAST(count(e.t) FILTER (e.t < r.length) AS INTEGER) AS bucket, min(e.t) FILTER (e.t >= r.length) AS boundary FROM rows r, edges e GROUP BY r.doc_id, r.length),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h % cells, h, doc_id, length) - 1 AS rank, greatest(1, {budget} // greatest(boundary, 1)) AS room
  FROM (SELECT *, ((doc_id % {PRIME}) + {PRIME}) % {PRIME} * {CELL_FACTOR} % {PRIME} AS h FROM placed), (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS cells FROM rows))
SELECT doc_id, length, bucket, boundary, CAST(rank // room AS BIGINT) AS batch, CAST(rank % room AS BIGINT) AS place, boundary - length AS padding FROM ranked
"""
