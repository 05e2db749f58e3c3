"""Mixing sources to target weights.

Each source's documents, in a fixed order, are one stream of words, cut into blocks of ``block`` words.
The mix is a sequence of slots, dealt over output shards.  A shard's source counts are a multinomial draw
conditioned on the sources' totals (so that every source ends at its target, not near it by chance): one
pseudorandom permutation over all slots says which shard and place each of a source's slots has.  A
slot's ordinal within its source goes through the source's own permutation of block indices, once for
every epoch, and slots meet blocks by (source, index).  DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitspark.llm.permute import PRIME, permuted, permuted_sql
from bitspark.llm.scratch import store

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
CELL_FACTOR = 1_103_515_245
FAN = 1 << 12  # slots made from one row of a source's runs


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def plan_sources(sized: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 128) -> DataFrame:
    """Per source: ``source, rank, source_size, target, blocks, slots, first_slot``.

    ``sized(source, size)`` is summed by source.  Sources in code point order, null last, weigh
    ``weights`` in turn and share ``share`` times all words; no target exceeds ``most`` times its source.
    The common level at which the shares settle is found in closed form from the sources ordered by
    the level at which each would be full.  Slots are whole blocks, so that a source's words come within a
    block of its target.  Sources may be as many as web domains: none of the steps puts them in one task.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = running(sums, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "ranks")
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    src = src.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("level", F.col("cap") / F.col("weight"))
    src = running(src, [F.col("level"), F.col("rank")], {"cap_before": F.col("cap"), "w_before": F.col("weight")}, "levels")
    all_ = src.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    total = float(all_[1]) * share
    # words used up if the level rises until this source is full
    full = F.col("cap_before") + F.col("cap") + F.col("level") * (F.lit(all_[0]) - F.col("w_before") - F.col("weight")) <= F.lit(total)
    src = src.withColumn("full", full)
    done = src.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)), F.lit(0))).first()
    level = F.lit((total - float(done[0])) / done[1] if done[1] else None).cast("double")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level * F.col("weight")))
    src = src.withColumn("target", target).withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("bigint"))
    slots = F.when(F.col("source_size") > 0, F.least(F.col("blocks") * most, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5))).otherwise(0).cast("bigint")
    src = running(src.withColumn("slots", slots), [F.col("rank")], {"first_slot": F.col("slots")}, "slots")
    return src.select("source", "rank", "source_size", "target", "blocks", "slots", "first_slot", F.lit(src.agg(F.sum("slots")).first()[0] or 0).alias("all_slots"))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``df`` with a column for each of ``sums``: its sum over the rows before in ``order``, which must tell all rows apart.

    Rows are dealt in ranges and summed in each; only the ranges' sums, one row for each, meet in one task.
    """
    dealt = store(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).select("*", *[c.cast("bigint").alias(f"__{k}") for k, c in sums.items()]), name)
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    bases = dealt.groupBy("__range").agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in sums]).select("__range", *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__base_{k}") for k in sums])
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.select("*", *[F.coalesce(F.sum(f"__{k}").over(inside), F.lit(0)).alias(f"__in_{k}") for k in sums]).join(bases, "__range")
    return out.select(*df.columns, *[(F.col(f"__base_{k}") + F.col(f"__in_{k}")).cast("bigint").alias(k) for k in sums])


def draw_slots(sources: DataFrame, *, seed: int = 1, shard_slots: int = 4096) -> DataFrame:
    """Every slot of the mix: ``rank, ordinal, index, shard, place``.

    ``index`` is the block of the source that the slot holds: its ordinal within the epoch, permuted.
    ``shard`` and ``place`` come from the permutation over all slots; counting rows by shard and rank
    gives the draw of source counts.
    """
    runs = sources.where("slots > 0").withColumn("run", F.explode(F.expr(f"sequence(0L, (slots - 1) div {FAN})")))
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.select("rank", "blocks", "slots", "first_slot", "all_slots", "run").repartition(parts, "rank", "run")
    slots = runs.withColumn("ordinal", F.explode(F.expr(f"sequence(run * {FAN}, least(slots, (run + 1) * {FAN}) - 1)")))
    epoch = F.expr("ordinal div blocks")
    index = permuted(F.col("ordinal") % F.col("blocks"), F.col("blocks"), F.col("rank"), seed)
    slot = permuted(F.col("first_slot") + F.col("ordinal"), F.col("all_slots"), F.lit(0), seed + 1)
    return slots.select("rank", "ordinal", epoch.alias("epoch"), index.alias("index"), slot.alias("slot")).select(
        "rank", "ordinal", "epoch", "index", F.expr(f"slot div {shard_slots}").alias("shard"), F.expr(f"slot % {shard_slots}").alias("place")
    )


def word_offsets(docs: DataFrame, ties: list[str] = []) -> DataFrame:  # noqa: B006
    """``docs(rank, doc_id, size, salt)`` -> with ``start``: where the document begins in its source's stream.

    Documents are ordered by (cell, id), equal ids by size and ``ties``; the square root of the row count is the number of cells, so that
    neither a cell of a source nor the list of a source's cells grows in proportion to the table.  Null ids are dealt by ``salt``.
    """
    n = docs.select(F.ceil(F.sqrt(F.greatest(F.count("*"), F.lit(1)))).cast("bigint").alias("cells"))
    cell = F.pmod(F.coalesce(F.col("doc_id"), F.col("salt"), F.lit(0)), F.lit(PRIME)) * F.lit(CELL_FACTOR).cast("bigint") % F.lit(PRIME) % F.col("cells")
    docs = docs.withColumn("cells", F.lit(n.first()["cells"])).withColumn("cell", cell)
    within = W.partitionBy("rank", "cell").orderBy(F.col("doc_id").asc_nulls_first(), "size", *ties).rowsBetween(W.unboundedPreceding, -1)
    cells = docs.groupBy("rank", "cell").agg(F.sum("size").alias("words"))
    across = W.partitionBy("rank").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("rank", "cell", F.coalesce(F.sum("words").over(across), F.lit(0)).alias("base"))
    docs = docs.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return docs.join(cells, ["rank", "cell"]).withColumn("start", (F.col("base") + F.col("inner")).cast("bigint")).drop("cells", "cell", "inner", "base", "salt")


def cut_blocks(docs: DataFrame, block: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``(rank, doc_id, start, size)`` -> a row for each block that a document reaches into: ``index, skip, words``, of the document's own words."""
    reach = docs.where("size > 0").withColumn("index", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    lo = F.greatest(F.col("start"), F.col("index") * block)
    hi = F.least(F.col("start") + F.col("size"), (F.col("index") + 1) * block)
    return reach.select("rank", "doc_id", *keys, "start", "index", (lo - F.col("start")).alias("skip"), (hi - lo).alias("words"))


def _planned(
    docs: DataFrame, *, doc_id: str, text: str, source: str, weights: tuple[int, ...], share: float, most: int, block: int, seed: int, shard_slots: int, key: Column | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(sources, placed, slots, pieces)`` of a mix; ``key``, if given, goes with each document into ``placed`` and ``pieces``."""
    keys = [] if key is None else ["key"]
    own = [] if key is None else [key.alias("key")]
    salt = F.when(F.col(f"`{doc_id}`").isNull(), F.xxhash64(f"`{text}`")).alias("salt")
    sized = store(docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), salt, *own), "sized")
    sources = store(plan_sources(sized, weights=weights, share=share, most=most, block=block), "sources")
    ranked = sized.join(sources.select("source", "rank"), sized["source"].eqNullSafe(sources["source"])).select(sized["doc_id"], "rank", "size", "salt", *keys)
    placed = store(word_offsets(ranked, keys), "placed")
    return sources, placed, draw_slots(sources, seed=seed, shard_slots=shard_slots), cut_blocks(placed, block, keys)


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 128, seed: int = 1, shard_slots: int = 4096,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plan a mix of all documents: ``(documents, slots, pieces)``.

    ``documents``: ``doc_id, source, size, source_size, target, taken, shards, first_shard, first_place`` for
    every row; ``taken`` is the number of its words in the mix, repeats counted, ``shards`` the number of
    output shards that hold some of them, and the last two say where they come first (null if nowhere).
    ``slots``: see ``draw_slots``.  ``pieces``: which words of which document each block holds, to be joined
    with ``slots`` by (rank, index).

    A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``; null or blank texts have none and
    none are taken.  A null source is a source of its own, last in order; a source without words gets
    target 0.  Equal rows share what is taken by their place in the stream; a null id comes first in its
    cell.  No document is taken more than ``most`` times.  Other columns are ignored, whatever their
    names; an empty table gives empty results.  Equal inputs, seeds and parameters give equal results.
    """
    sources, placed, slots, pieces = _planned(docs, doc_id=doc_id, text=text, source=source, weights=weights, share=share, most=most, block=block, seed=seed, shard_slots=shard_slots)
    # sizes are estimated before rows are exploded, so that without the hint this could become a broadcast
    held = pieces.join(slots.hint("merge"), ["rank", "index"])
    who = [F.col("rank").alias("k_rank"), F.col("doc_id").alias("k_id"), F.col("start").alias("k_start")]
    by_shard = held.groupBy(*who, "shard").agg(F.sum("words").alias("words"), F.min("place").alias("place"))
    taken = by_shard.groupBy("k_rank", "k_id", "k_start").agg(F.sum("words").alias("taken"), F.count("*").alias("shards"), F.min(F.struct("shard", "place")).alias("first"))
    same = F.col("k_id").eqNullSafe(F.col("doc_id")) & (F.col("k_rank") == F.col("rank")) & (F.col("k_start") == F.col("start"))
    zero = F.lit(0).cast("bigint")
    cols = ["rank", "doc_id", "size", F.coalesce("taken", zero).alias("taken"), F.coalesce("shards", zero).alias("shards"), F.col("first.shard").alias("first_shard"), F.col("first.place").alias("first_place")]
    out = placed.where("size > 0").join(taken, same, "left").select(*cols)
    out = out.union(placed.where("size = 0").select("rank", "doc_id", "size", zero, zero, F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))
    table = out.join(sources.select("rank", "source", "source_size", "target"), "rank").select("doc_id", "source", "size", "source_size", "target", "taken", "shards", "first_shard", "first_place")
    return table, slots, pieces


def _drawn_text(text: Column, parts: Column) -> Column:
    """The words of ``text`` that ``parts``, an ordered array of (skip, words), name, with the white space between them; a blank line stands for a gap."""
    tokens = F.regexp_extract_all(text, F.lit(rf"{BLANK}*{WORD}"), F.lit(0))
    bare = lambda x: F.regexp_replace(x, f"^{BLANK}+", "")

    def join(t: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            own, before = F.array_join(F.slice(t, p["skip"].cast("int") + 1, p["words"].cast("int")), ""), F.get(parts, i - 1)
            return F.when(i == 0, F.when(p["skip"] == 0, own).otherwise(bare(own))).when(before["skip"] + before["words"] == p["skip"], own).otherwise(F.concat(F.lit("\n\n"), bare(own)))

        return F.array_join(F.transform(parts, one), "")

    return F.get(F.transform(F.array(tokens), join), F.lit(0))


def mixed_documents(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", chars: str = "n_chars", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = 128, seed: int = 1, shard_slots: int = 4096,
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each epoch of its source that takes words of a document.

    The text is made of the drawn blocks' words, slots joined with pieces, so that the words of a source are
    those that ``mix`` counts as ``taken``; ``chars``, if there is such a column, is set to a cut text's length.
    A document taken whole is as it was, one of which nothing is taken (null and blank texts too) is left
    out.  Rows are told apart by a 64-bit hash of all their columns, so that different texts under one id, or
    under none, are taken apart; repeated rows are taken each.  A null source is a source of its own.  An empty
    table gives an empty one.
    """
    key = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"`{c}`").isNull() for c in docs.columns])
    _, _, slots, pieces = _planned(docs, doc_id=doc_id, text=text, source=source, weights=weights, share=share, most=most, block=block, seed=seed, shard_slots=shard_slots, key=key)
    taken = pieces.join(slots.select("rank", "index", "epoch").hint("merge"), ["rank", "index"])
    parts = taken.groupBy(F.col("key").alias("__key"), "start", "epoch").agg(F.sort_array(F.collect_list(F.struct("skip", "words"))).alias("__parts"))
    rows = docs.select(key.alias("__key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")).groupBy("__key").agg(F.first("__row").alias("__row"))
    both = rows.hint("merge").join(parts.select("__key", "__parts"), "__key")
    words = F.aggregate("__parts", F.lit(0).cast("bigint"), lambda n, p: n + p["words"])
    own = F.col(f"__row.`{text}`")
    both = both.withColumn("__whole", words == word_count(own)).withColumn("__text", F.when(F.col("__whole"), own).otherwise(_drawn_text(own, F.col("__parts"))))
    made = {text: F.col("__text")} | ({chars: F.when(F.col("__whole"), F.col(f"__row.`{chars}`")).otherwise(F.char_length("__text"))} if chars in docs.columns else {})
    return both.select(*[made.get(c, F.col(f"__row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


ORACLE_MIX_CELLS = "((CASE WHEN doc_id IS NULL THEN 0 ELSE ((doc_id % {p}) + {p}) % {p} END) * {f} % {p} % cells)"


def oracle(seed: int = 1, block: int = 128, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, shard_slots: int = 4096) -> str:
    """The same mix as one SQL statement over ``documents``, whose ids aren't null."""
    walk = lambda name, base, s: f"""{name} AS (  -- images; those beyond n are permuted again
  {permuted_sql(base, s)} UNION ALL {permuted_sql(f"SELECT * FROM {name} WHERE v >= n", s)})"""  # noqa: E731
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    cell = ORACLE_MIX_CELLS.format(p=PRIME, f=CELL_FACTOR)
    return rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM sums),
weighed AS (SELECT *, CASE rank % {len(weights)} {cases} END AS weight, source_size * {most} AS cap FROM ranked),
levels AS (
  SELECT *, CAST(sum(weight) OVER () AS BIGINT) AS w_all, CAST(sum(source_size) OVER () AS DOUBLE) * CAST({share} AS DOUBLE) AS total,
    CAST(sum(cap) OVER f AS BIGINT) AS cap_below, CAST(sum(weight) OVER f AS BIGINT) AS w_run
  FROM weighed WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), rank ROWS UNBOUNDED PRECEDING)),
fulls AS (SELECT *, cap_below + (CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE)) * (w_all - w_run) <= total AS fl FROM levels),
opened AS (
  SELECT *, total - CAST(sum(CASE WHEN fl THEN cap ELSE 0 END) OVER () AS DOUBLE) AS rest, CAST(sum(CASE WHEN fl THEN 0 ELSE weight END) OVER () AS DOUBLE) AS open_w FROM fulls),
targets AS (
  SELECT *, CASE WHEN fl THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), (rest / open_w) * weight) END AS target,
    (source_size + {block - 1}) // {block} AS blocks FROM opened),
quotas AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(blocks * {most}, CAST(floor(target * blocks / source_size + CAST(0.5 AS DOUBLE)) AS BIGINT)) ELSE 0 END AS slots FROM targets),
slots AS (
  SELECT *, CAST(coalesce(sum(slots) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_slot, CAST(sum(slots) OVER () AS BIGINT) AS all_slots FROM quotas),
expanded AS (SELECT rank, blocks, first_slot, all_slots, unnest(generate_series(0, slots - 1)) AS ordinal FROM slots WHERE slots > 0),
{walk("indexed", f"SELECT rank, ordinal, ordinal % blocks AS v, blocks AS n, (rank + 1) % {PRIME} AS k1 FROM expanded", seed)},
{walk("dealt", "SELECT rank, ordinal, first_slot + ordinal AS v, all_slots AS n, 1::BIGINT AS k1 FROM expanded", seed + 1)},
drawn AS (
  SELECT i.rank, i.v AS idx, d.v // {shard_slots} AS shard, d.v % {shard_slots} AS place
  FROM indexed i JOIN dealt d ON i.rank = d.rank AND i.ordinal = d.ordinal AND i.v < i.n AND d.v < d.n),
celled AS (
  SELECT s.doc_id, t.rank, s.size, {cell.replace("doc_id", "s.doc_id")} AS cell
  FROM sized s JOIN slots t ON s.source IS NOT DISTINCT FROM t.source, (SELECT CAST(ceil(sqrt(greatest(count(*), 1))) AS BIGINT) AS cells FROM documents)),
placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY rank ORDER BY cell, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM celled),
pieces AS (SELECT *, unnest(generate_series(start // {block}, (start + size - 1) // {block})) AS idx FROM placed WHERE size > 0),
took AS (
  SELECT p.rank, p.doc_id, p.start, CAST(sum(least(p.start + p.size, (p.idx + 1) * {block}) - greatest(p.start, p.idx * {block})) AS BIGINT) AS taken,
    count(DISTINCT d.shard) AS shards, min(struct_pack(shard := d.shard, place := d.place)) AS first
  FROM pieces p JOIN drawn d ON p.rank = d.rank AND p.idx = d.idx GROUP BY p.rank, p.doc_id, p.start)
SELECT p.doc_id, p.size, t.source_size, t.target, coalesce(k.taken, 0) AS taken, coalesce(k.shards, 0) AS shards, k.first.shard AS first_shard, k.first.place AS first_place
FROM placed p JOIN slots t ON p.rank = t.rank
LEFT JOIN took k ON k.rank = p.rank AND k.doc_id IS NOT DISTINCT FROM p.doc_id AND k.start = p.start AND p.size > 0
"""
