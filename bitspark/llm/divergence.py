"""Divergence audit of sources: how far the sources of a language are from each other, term by term.

Inside a task texts stay the UTF-8 buffer that Arrow gives: a lookup table of 256 bytes tells letters from
the rest and lowers them, its edges are the terms, slices are hashed by xxHash64, all at once, and slices of one
hash are compared byte by byte before they count as one term.  Spark adds up the counts by language and term,
which also gives the documents that hold a term, and deals a language's terms to blocks.  A block is a sparse
matrix in CSR form, a row for each source and a column for each term.  A source without a term still has its
smoothed share, the same for all such terms, so a block's sums need only the entries that are there: each
source's row is compared with all entries at once, and ``reduceat`` adds them up by row.

All arithmetic is in whole numbers: shares are in billionths, rounded down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitspark.llm.scratch import Stored, small

U = np.uint64
CHUNK_BYTES = 1 << 22
TABLE_ROWS = 1 << 20  # counts that a task gathers before it sends them on
BLOCK_ENTRIES = 1 << 15
LONG = 32  # bytes; xxHash64 treats longer input in another way
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
FOUND = "lang string, source string, part string, item string, value bigint"

#: The byte in lower case if it belongs to a term, else 0: ASCII letters, and all bytes of other characters.
LOWER = np.zeros(256, np.uint8)
LOWER[128:] = np.arange(128, 256)
LOWER[97:123] = LOWER[65:91] = np.arange(97, 123)

# The primes of xxHash64.
P1, P2, P3, P4, P5 = (U(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


# ---------------------------------------------------------------- terms of a buffer


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie end to end in ``data``, text i from ``offsets[i]``: the lowered bytes, and each term's start, size and text."""
    low = LOWER[data]
    inside = low != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]  # a term ends with its text
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    return low, starts, sizes, np.searchsorted(offsets, starts, "right") - 1


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return x << U(bits) | x >> U(64 - bits)


def _lanes(low: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one number; beyond the end are zeros."""
    padded = np.concatenate((low, np.zeros(LONG + 8, np.uint8)))
    return np.ascontiguousarray(np.ndarray(len(low) + LONG, "<u8", padded, strides=(1,)))


def hashes(low: np.ndarray, lanes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxHash64 (seed 0) of every slice."""
    h = P5 + sizes.astype(U)
    for k in range(LONG // 8 - 1):
        on = np.flatnonzero(sizes >= 8 * (k + 1))
        h[on] = _turn(h[on] ^ _turn(lanes[starts[on] + 8 * k] * P2, 31) * P1, 27) * P1 + P4
    at, rest = starts + (sizes & ~7), sizes & 7
    on = np.flatnonzero((rest >= 4) & (sizes < LONG))
    h[on] = _turn(h[on] ^ (lanes[at[on]] & U(0xFFFFFFFF)) * P1, 23) * P2 + P3
    at, rest = at + (rest & 4), rest & 3
    for k in range(3):
        on = np.flatnonzero((rest > k) & (sizes < LONG))
        h[on] = _turn(h[on] ^ low[at[on] + k].astype(U) * P5, 11) * P1
    h = (h ^ h >> U(33)) * P2
    h = (h ^ h >> U(29)) * P3
    h ^= h >> U(32)
    for i in np.flatnonzero(sizes >= LONG):
        h[i] = xxhash.xxh64_intdigest(low[starts[i] : starts[i] + sizes[i]].tobytes())
    return h


def grouped(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashed=hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(order, term, example)``: slices in order of their term, the term of each in that order, and for each term its first slice."""
    lanes = _lanes(low)
    h = hashed(low, lanes, starts, sizes)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    term, example = np.cumsum(new) - 1, order[new]
    # every slice against the first of its hash
    one, two = order[~new], example[term[~new]]
    differ = sizes[one] != sizes[two]
    short = np.flatnonzero(~differ & (sizes[one] < LONG))
    for k in range(LONG // 8):
        short = short[sizes[one[short]] > 8 * k]
        left = np.minimum(sizes[one[short]] - 8 * k, 8).astype(U)
        unlike = (lanes[starts[one[short]] + 8 * k] ^ lanes[starts[two[short]] + 8 * k]) << (U(64) - U(8) * left)
        differ[short[unlike != 0]] = True
    raw = lambda i: low[starts[i] : starts[i] + sizes[i]].tobytes()
    for k in np.flatnonzero(~differ & (sizes[one] >= LONG)):
        differ[k] = raw(one[k]) != raw(two[k])
    if differ.any():  # different terms of one hash: told apart by their bytes
        more = example.tolist()
        for t in np.unique(term[~new][differ]):
            seen: dict[bytes, int] = {}
            for k in np.flatnonzero(term == t):
                own = seen.setdefault(raw(order[k]), t if not seen else len(more))
                if own == len(more):
                    more.append(order[k])
                term[k] = own
        again = np.argsort(term, kind="stable")
        order, term, example = order[again], term[again], np.array(more)
    return order, term, example


def counted(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in ``data``, text i of group ``group[i]``: terms, groups, occurrences and texts that hold the term, a row for each term and group."""
    low, starts, sizes, texts = slices(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return pa.array([], pa.string()), none, none, none
    order, term, example = grouped(low, starts, sizes)
    text = texts[order]
    new = np.ones(len(order), bool)
    new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    times = np.diff(at, append=len(order))  # of a term in a text
    key = term[at] * n_groups + group[text[at]]
    by = np.argsort(key, kind="stable")
    key = key[by]
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n, held = np.add.reduceat(times[by], edge), np.diff(edge, append=len(key))
    lengths = sizes[example]
    ends = np.cumsum(lengths)
    body = low[np.arange(ends[-1]) + np.repeat(starts[example] - (ends - lengths), lengths)]
    bounds = np.concatenate(([0], ends)).astype(np.int32)
    names = pa.Array.from_buffers(pa.string(), len(example), [None, pa.py_buffer(bounds), pa.py_buffer(body)])
    return names.take(pa.array(key[edge] // n_groups)), key[edge] % n_groups, n, held


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array without nulls, and where each text starts in them (one more at the end)."""
    wide = pa.types.is_large_string(texts.type)
    _, where, body = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """A long text in pieces of about ``limit`` bytes that end where no term is."""
    at = 0
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data):
            gap = np.flatnonzero(LOWER[data[end : end + limit]] == 0)
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + limit, len(data))
        yield data[at:end]
        at = end


def _texts_of(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, n_groups: int, limit: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """``counted`` over runs of texts of about ``limit`` bytes; a longer text is counted in pieces, and holds a term once."""
    i = 0
    while i < len(group):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        part = data[offsets[i] : offsets[j]]
        if len(part) <= limit:
            yield counted(part, offsets[i : j + 1] - offsets[i], group[i:j], n_groups)
        else:
            seen: dict[str, int] = {}
            for piece in _pieces(part, limit):
                names, _, n, _ = counted(piece, np.array([0, len(piece)]), np.zeros(1, np.int64), 1)
                for name, k in zip(names.to_pylist(), n.tolist(), strict=True):
                    seen[name] = seen.get(name, 0) + k
            yield pa.array(list(seen), pa.string()), np.full(len(seen), group[i]), np.array(list(seen.values()), np.int64), np.ones(len(seen), np.int64)
        i = j


def count_terms(chunk: int = CHUNK_BYTES, rows: int = TABLE_ROWS):
    """For ``mapInArrow`` over ``(lang, source, text)``: counts by group and term, added up inside the task, and an empty term for every group."""
    keys, schema = ["lang", "source", "term"], pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def added(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return sums.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(schema.names).cast(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, last = [], 0, 0
        for batch in batches:
            kinds: dict[tuple[str, str], int] = {}
            group = np.array([kinds.setdefault(g, len(kinds)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
            named = [pa.array([g[k] for g in kinds], pa.string()) for k in (0, 1)]
            zero = np.zeros(len(kinds), np.int64)
            data, offsets = _buffer(batch.column("text"))
            for names, at, n, docs in [(pa.array([""] * len(kinds), pa.string()), np.arange(len(kinds)), zero, zero), *_texts_of(data, offsets, group, len(kinds), chunk)]:
                waiting.append(pa.table([*(c.take(pa.array(at)) for c in named), names, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=schema))
                size += len(names)
                if size > last + rows:
                    waiting = [added(waiting)]
                    size = last = len(waiting[0])
                    if size > rows:
                        yield from waiting[0].to_batches(max_chunksize=1 << 16)
                        waiting, size, last = [], 0, 0
        if waiting:
            yield from added(waiting).to_batches(max_chunksize=1 << 16)

    return run


# ---------------------------------------------------------------- divergences of a block


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), exact for totals below 9 * 10^15 and count below total."""
    rest, out = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    out += rest // total
    rest = rest % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def unlike(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)"""
    d = p - q
    return d * d // q


def divergences(row: np.ndarray, col: np.ndarray, n: np.ndarray, totals: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row of a CSR matrix of counts (entries in order of ``row``) its sums of ``unlike`` to every row over ``width`` columns; ``totals`` are the shares' denominators."""
    p, p0 = shares(n, totals[row]), shares(np.zeros(len(totals), np.int64), totals)
    edge = np.searchsorted(row, np.arange(len(totals) + 1))
    full = np.flatnonzero(edge[1:] > edge[:-1])
    for g in range(len(totals)):
        own = np.full(width, p0[g])
        mine = slice(edge[g], edge[g + 1])
        own[col[mine]] = p[mine]
        # every column as if the other row had nothing there, then what its entries change
        sums = (width - (edge[g + 1] - edge[g])) * unlike(p0[g], p0) + unlike(p[mine][:, None], p0[None, :]).sum(axis=0)
        if len(full):
            here = own[col]
            sums[full] += np.add.reduceat(unlike(here, p) - unlike(here, p0[row]), edge[full])
        yield sums


def compare_block(most: int):
    """For a cogrouped language and block: ``(source, term, n, lang_n)`` and ``(source, total, lang_total)`` -> partial sums of pairs, and each source's first terms of the block."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right["source"].cast(pa.binary())))
        names = right["source"].combine_chunks()
        place = pc.index_in(left["source"], names).to_numpy()
        coded = left["term"].combine_chunks().dictionary_encode() if len(left) else pa.array([], pa.string()).dictionary_encode()
        words, term = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        rank = np.empty(len(words), np.int64)
        rank[pc.sort_indices(words.cast(pa.binary())).to_numpy()] = np.arange(len(words))  # columns in the order of their bytes
        by = np.lexsort((rank[term], place))
        row, col, term = place[by].astype(np.int64), rank[term][by], term[by]
        n, lang_n = (left[c].to_numpy()[by].astype(np.int64) for c in ("n", "lang_n"))
        totals, lang_total = (np.maximum(right[c].to_numpy().astype(np.int64), 1) for c in ("total", "lang_total"))
        size = len(totals)
        a, b, value = [], [], []
        for g, sums in enumerate(divergences(row, col, n, totals, len(words))):
            others = np.delete(np.arange(size), g)
            a.append(np.full(size - 1, g))
            b.append(others)
            value.append(sums[others])
        pairs = pa.table({"source": names.take(pa.array(np.concatenate(a))), "item": names.take(pa.array(np.concatenate(b))), "value": np.concatenate(value)}) if size else None
        p, q = shares(n, totals[row]), shares(lang_n, np.broadcast_to(lang_total[:1], n.shape))
        above = np.flatnonzero(p > q)
        score = unlike(p[above], q[above])
        best = np.lexsort((col[above], -score, row[above]))
        at = row[above][best]
        best = best[np.arange(len(best)) - np.searchsorted(at, at) < most]
        terms = pa.table({"source": names.take(pa.array(row[above][best])), "item": words.take(pa.array(term[above][best])), "value": score[best]})
        out = []
        for part, t in (("pair", pairs), ("term", terms)):
            if t is not None and len(t):
                fixed = [pa.array([v] * len(t), pa.string()) for v in (key[0].as_py(), part)]
                out.append(pa.table([fixed[0], t["source"], fixed[1], t["item"], t["value"].cast(pa.int64())], names=["lang", "source", "part", "item", "value"]))
        empty = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
        return pa.concat_tables(out) if out else empty.empty_table()

    return run


# ---------------------------------------------------------------- over a table


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3) -> DataFrame:
    """``lang, source, term, n, lang_n, leads``: the terms that at least ``min_docs`` documents of a language hold, and for every group a row without one.

    ``lang_n`` is the term's count in the whole language; of a term's rows one ``leads``.
    """
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(a) for a, c in (("lang", lang), ("source", source), ("text", text))])
    # added up inside the tasks, so dealt at once to where a term's documents can be counted
    counts = rows.mapInArrow(count_terms(), COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    known = counts.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("held"), F.sum("n").over(of_term).alias("lang_n"), (F.col("source") == F.min("source").over(of_term)).alias("leads"))
    return known.where((F.col("held") >= min_docs) | (F.col("term") == "")).select("lang", "source", "term", "n", "lang_n", ((F.col("term") != "") & F.col("leads")).alias("leads"))


def audit_sources(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3, most: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank``: each source's distance to the others of its language, and the terms that set it apart.

    A term is a run of ASCII letters and of characters beyond ASCII, A-Z lowered; a language keeps those that
    ``min_docs`` of its documents hold.  A share is 1 + floor(10^9 (count + 1) / (all counts + terms)).  Part ``pair``
    has for each other source the sum of floor((p - q)^2 / q) over all terms, q being its shares; part ``term`` the
    ``most`` terms of the greatest value among those that the source has above the language's own share.  Ranks go by
    falling value, then by the item's UTF-8 bytes.

    Null texts, languages and sources are empty strings.  A group without terms still has its distances (of 0 if the
    language has no terms); a source alone in its language has none.  Repeated rows count each.  Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    known = Stored(term_counts(docs, text=text, lang=lang, source=source, min_docs=min_docs), "terms").df
    groups = known.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("leads").cast("bigint")).alias("v"), F.sum((F.col("term") != "").cast("bigint")).alias("entries"))
    groups = Stored(groups, "groups").df
    # a block's partial sums are as many as the pairs of sources, so its entries are no fewer
    blocks = F.greatest(F.lit(1), F.ceil(F.sum("entries") / F.greatest(F.lit(BLOCK_ENTRIES), F.count("*") * F.count("*")))).cast("int")
    langs = Stored(groups.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("v").alias("v"), blocks.alias("blocks")), "langs").df.withColumn("lang_total", F.col("lang_total") + F.col("v"))
    entries = known.where("term <> ''").join(small(langs.select("lang", "blocks")), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    sides = groups.select("lang", "source", "n").join(small(langs), "lang").select("lang", "source", (F.col("n") + F.col("v")).alias("total"), "lang_total", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    met = entries.select("lang", "block", "source", "term", "n", "lang_n").groupBy("lang", "block").cogroup(sides.groupBy("lang", "block"))
    found = Stored(met.applyInArrow(compare_block(most), FOUND), "found").df
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).cast("int").alias("rank")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).select("*", rank)
    return pairs.union(found.where("part = 'term'").select("*", rank).where(F.col("rank") <= most))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, sum(lang_n) AS total, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1)) // (s.total + v.v) AS p, 1 + (CAST(1000000000 AS HUGEINT) * (lang_n + 1)) // (v.total + v.v) AS q
  FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
