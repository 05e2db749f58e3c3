"""Language-model scores by deleted interpolation of word trigrams.

A token's probability mixes four estimates: the maximum-likelihood trigram, bigram and unigram, and the
uniform distribution over known words and one unknown.  The lower three are mixed first, by how often the
word before was seen (a bucket for each power of two); that and the trigram are mixed by how often the two
words before were.  All weights are learned by expectation-maximisation: a deleted part of the training
documents is predicted from the counts of the rest.

Texts become chunks, those of the deleted part apart: sorted word keys and, for every token, the word's
rank by its frequency in the chunk.  A chunk asks for the
counts of its distinct unigrams, bigrams and trigrams, cut into ranges of the key; a range adds up what the chunks
hold and answers each in the order asked.  A frequent word costs one entry a chunk, never one an
occurrence, and no table of counts is ever in one place.  Keys of words have 64 bits.  Those of
bigrams and trigrams have 16 bits more than it takes to number all tokens, so that at any size of the corpus
one in 30,000 or fewer shares its key with another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitspark.llm.scratch import Stored
from bitspark.llm.textkit import U, chunks, mix, words

END, START = U(0x2545F4914F6CDD1C), U(0x5851F42D4C957F2C)
CHUNKS = "chunk bigint, deleted boolean, doc_ids array<bigint>, held array<boolean>, lengths binary, keys binary, times binary, tokens binary, n bigint"
ASKED = "part int, chunk bigint, keys binary, long binary, fit binary, cut binary"
ASKED_TYPES = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
ANSWER = "part int, chunk bigint, fit binary, cut binary, n_fit bigint, n_cut bigint, v_fit bigint, v_all bigint"
CELLS = "bucket int, q2 int, q1 int, n bigint, s2 double, s1 double"
RUN = 1 << 16  # tokens that are keyed, put into cells or scored at a time
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, score_apart double"


def _pack(a: np.ndarray) -> bytes:
    """Unsigned integers as compressed planes of their bytes: small numbers and sorted differences have empty high planes."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=2).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(dtype).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=U(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, U), dtype=U)


def _spare(tokens: int) -> U:
    """Low bits that the keys of bigrams and trigrams leave unused, of 64."""
    return U(64 - min(63, max(40, tokens.bit_length() + 16)))


def _join_keys(words_of: bytes, long: bytes, spare: U) -> np.ndarray:
    """The sorted keys that ``_ask`` packed apart."""
    return np.sort(np.concatenate((_unpack_sorted(words_of), _unpack_sorted(long) << spare | U(1))))


# ---------------------------------------------------------------- chunks


def _tokenise(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        serial = TaskContext.get().partitionId() << 32
        for whole in batches:
            for deleted, pdf in whole.groupby("deleted", sort=False):
                ids, held = pdf["doc_id"].tolist(), pdf["held"].tolist()
                for first, raw in chunks(pdf["text"].tolist(), limit):
                    found, offsets = words(raw)
                    counts = np.diff(offsets)
                    tokens, word = np.full(len(found) + len(raw), END), np.ones(len(found) + len(raw), bool)
                    word[np.cumsum(counts + 1) - 1] = False
                    tokens[word] = found
                    del found
                    tokens &= ~U(1)
                    keys, index = _numbered(tokens)
                    times = np.bincount(index, minlength=len(keys))
                    rank = np.empty(len(keys), np.uint32)
                    rank[_by_frequency(times)] = np.arange(len(keys), dtype=np.uint32)
                    sl = slice(first, first + len(raw))
                    yield pd.DataFrame({
                        "chunk": [serial], "deleted": [deleted], "doc_ids": [[None if x is None or x != x else int(x) for x in ids[sl]]], "held": [held[sl]],
                        "lengths": [_pack((counts + 1).astype(np.uint32))], "keys": [_pack_sorted(keys)], "times": [_pack(times.astype(np.uint32))], "tokens": [_pack(rank[index])], "n": [len(tokens)],
                    })
                    serial += 1

    return run


def _by_frequency(times: np.ndarray) -> np.ndarray:
    return np.lexsort((np.arange(len(times)), -times.astype(np.int64))).astype(np.int32)


def _first_of(run: np.ndarray) -> np.ndarray:
    """Where a sorted run has a value for the first time."""
    new = np.ones(len(run), bool)
    np.not_equal(run[1:], run[:-1], out=new[1:])
    return new


def _numbered(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and each one's place among them: ``np.unique`` with half the work space."""
    order = np.argsort(a)
    run = a[order]
    new = _first_of(run)
    index = np.empty(len(a), np.int32)
    index[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return run[new], index


def _distinct_of(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct values of all parts, sorted where they are put together."""
    run = np.concatenate(parts)
    run.sort()
    return run[_first_of(run)]


def _long(before: np.ndarray, factor: int, last: np.ndarray, spare: U) -> np.ndarray:
    """Keys of n-grams from those of the words before and the last words', some at a time."""
    out = np.empty(len(last), U)
    for at in range(0, len(last), RUN):
        run = slice(at, at + RUN)
        out[run] = mix(before[run] * U(factor) + last[run]) >> spare << spare | U(1)
    return out


class _Chunk:
    """A chunk's distinct n-grams: ``keys`` sorted, unigrams even, longer ones odd.

    ``uni``, ``bi`` and ``tri`` index them for every token, ``ctx`` and ``pair`` its one and two words before;
    the first token of a text has no two words before it (``first``).
    """

    def __init__(self, row, spare: U):
        self.ids, self.held = row["doc_ids"], np.asarray(row["held"], bool)
        self.lengths = _unpack(row["lengths"], np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        uni = _unpack_sorted(row["keys"])
        tokens = _by_frequency(_unpack(row["times"], np.uint32))[_unpack(row["tokens"], np.uint32)]
        held = np.repeat(self.held, self.lengths)
        self.cut, self.fit = ~held & bool(row["deleted"]), ~held & (not row["deleted"])
        start = START & ~U(1)
        self.first = np.zeros(len(tokens), bool)
        self.first[self.starts] = True
        words_of = uni[tokens]
        before = np.empty_like(words_of)
        before[1:] = words_of[:-1]
        before[self.starts] = start
        pair = _long(before, 0x9FB21C651E98DF25, words_of, spare)
        del before
        triple = _long(pair[:-1], 0xD6E8FEB86659FD93, words_of[1:], spare)[~self.first[1:]]  # the first token of all is a text's first
        del words_of
        pairs, pair_of = _numbered(pair)
        del pair
        triples, triple_of = _numbered(triple)
        del triple
        self.keys = _distinct_of([uni, np.array([start], U), pairs, triples])
        place = lambda keys: np.searchsorted(self.keys, keys).astype(np.int32)
        self.begin = int(place(start))
        self.uni, self.bi = place(uni)[tokens], place(pairs)[pair_of]
        self.ctx, self.pair, self.tri = np.full((3, len(tokens)), self.begin, np.int32)
        self.ctx[1:], self.pair[1:] = self.uni[:-1], self.bi[:-1]
        self.ctx[self.starts] = self.pair[self.starts] = self.begin
        self.tri[~self.first] = place(triples)[triple_of]

    def runs(self) -> Iterator[slice]:
        """Texts of about ``RUN`` tokens together, in order."""
        edge = np.flatnonzero(np.diff(self.starts // RUN, prepend=-1)).tolist() + [len(self.starts)]
        yield from (slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True))

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """Occurrences of each key among the tokens in ``mask``; the start key counts documents."""
        out = np.zeros(len(self.keys), np.uint32)
        for index, pick in ((self.uni, mask), (self.bi, mask), (self.tri, mask & ~self.first)):
            out += np.bincount(index[pick], minlength=len(out)).astype(np.uint32)
        out[self.begin] += np.uint32(mask[self.starts].sum())
        return out


# ---------------------------------------------------------------- counts


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    part = keys >> U(32)
    part *= U(parts)
    part >>= U(32)
    return part.view(np.int64)


def _ask(parts: int, spare: U):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # of many chunks: one at a time leaves Arrow's memory
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                c = _Chunk(row, spare)
                fit, cut = c.counts(c.fit), c.counts(c.cut)
                edge = np.searchsorted(_part(c.keys, parts), np.arange(parts + 1))
                word = c.keys & U(1) == 0
                split = lambda k, w: (_pack_sorted(k[w]), _pack_sorted(k[~w] >> spare))
                rows = [(p, row["chunk"], *split(c.keys[a:b], word[a:b]), _pack(fit[a:b]), _pack(cut[a:b])) for p, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if b > a]
                del c, fit, cut, word
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), ASKED_TYPES, strict=True)], names=[x.split()[0] for x in ASKED.split(", ")])

    return run


def _answer(pdf: pd.DataFrame, spare: U) -> pd.DataFrame:
    """All requests of one range -> counts over all chunks, in each chunk's own order, and the range's totals.

    A chunk's keys are distinct, so that its counts are added, and answered, by their places among the range's keys.
    """
    places = [_join_keys(k, long, spare) for k, long in zip(pdf["keys"], pdf["long"], strict=True)]
    keys = _distinct_of(places)
    for i, asked in enumerate(places):
        places[i] = np.searchsorted(keys, asked).astype(np.int32)
    total = {n: np.zeros(len(keys), np.int64) for n in ("fit", "cut")}
    for n, sums in total.items():
        for at, b in zip(places, pdf[n], strict=True):
            sums[at] += _unpack(b, np.uint32)
    rows = [(p, c, *(_pack(total[n][at].view(U)) for n in ("fit", "cut")), 0, 0, 0, 0) for p, c, at in zip(pdf["part"], pdf["chunk"], places, strict=True)]
    word = (keys & U(1) == 0) & (keys != START & ~U(1))
    fit, cut = total["fit"][word], total["cut"][word]
    rows.append((int(pdf["part"].iloc[0]), -1, None, None, int(fit.sum()), int(cut.sum()), int((fit > 0).sum()), int((fit + cut > 0).sum())))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in ANSWER.split(", ")])


def _with_answers(left: pd.DataFrame, right: pd.DataFrame, spare: U):
    right = right.sort_values("part")
    join = lambda n: np.concatenate([_unpack(b, U) for b in right[n]]).view(np.int64)
    for _, row in left.iterrows():
        yield _Chunk(row, spare), join("fit"), join("cut")


def buckets(c: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then one for each power of two."""
    return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0).astype(np.int64)


# ---------------------------------------------------------------- mixture weights


class _Seen:
    """Counts behind the tokens in ``pick``: of the word, the bigram, the trigram, and the one and two words before."""

    def __init__(self, c: _Chunk, counts: np.ndarray, pick: np.ndarray | slice):
        self.uni, self.bi, self.tri = counts[c.uni[pick]], counts[c.bi[pick]], np.where(c.first[pick], 0, counts[c.tri[pick]])
        self.ctx, self.pair = counts[c.ctx[pick]], np.where(c.first[pick], 0, counts[c.pair[pick]])

    def low(self, weights: np.ndarray, n: np.ndarray | int, v: int) -> np.ndarray:
        """Probabilities from bigram, unigram and uniform estimates."""
        w = weights[buckets(self.ctx)]
        return w[:, 2] * self.bi / np.maximum(self.ctx, 1) + w[:, 1] * self.uni / np.maximum(n, 1) + w[:, 0] / (v + 1)

    def high(self) -> np.ndarray:
        """Trigram estimates; 0 where the two words before were not seen."""
        return self.tri / np.maximum(self.pair, 1)

    def probability(self, weights: np.ndarray, trust: np.ndarray, n: np.ndarray | int, v: int) -> np.ndarray:
        w = trust[buckets(self.pair)]
        return w[:, 1] * self.high() + w[:, 0] * self.low(weights, n, v)

    def without(self, c: _Chunk, texts: slice, tokens: slice) -> "_Seen":
        """The counts less those that each text brought itself, if it is of the training documents."""
        lengths, first = c.lengths[texts], c.first[tokens]
        learnt = np.repeat(~c.held[texts], lengths)
        text = np.repeat(np.arange(len(lengths)), lengths)

        def own(index: np.ndarray) -> np.ndarray:
            _, which, times = np.unique(text * len(c.keys) + index[tokens], return_inverse=True, return_counts=True)
            return times[which] * learnt

        uni, bi, tri = own(c.uni), own(c.bi), own(c.tri) * ~first
        before = lambda x, start: np.where(first, start, np.roll(x, 1))
        out = object.__new__(_Seen)
        out.uni, out.bi, out.tri = self.uni - uni, self.bi - bi, self.tri - tri
        out.ctx, out.pair = self.ctx - before(uni, learnt), self.pair - before(bi, 0)
        return out


def _cells(spare: U, n_fit: int, v_fit: int, weights: np.ndarray | None = None):
    """Deleted tokens as a histogram over context bucket and half-powers of two of both estimates, with the estimates' sums.

    Without ``weights`` the estimates are bigram and unigram; with them, trigram and the mixture of the lower ones.
    The driver gets a row for each cell in use, of 66 x 121 x 121 at most, whatever the number of tokens.
    """

    quant = lambda f: np.where(f > 0, 1 + np.minimum(119, np.floor(-2 * np.log2(np.maximum(f, 1e-300)))), 0).astype(np.int64)
    summed = lambda cell: cell.groupby(["bucket", "q2", "q1"], as_index=False).sum()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c, fit, _ in _with_answers(left, right, spare):
            for at in range(0, len(c.cut), RUN):
                seen = _Seen(c, fit, at + np.flatnonzero(c.cut[at : at + RUN]))
                if weights is None:
                    context, f2, f1 = seen.ctx, seen.bi / np.maximum(seen.ctx, 1), seen.uni / max(n_fit, 1)
                else:
                    context, f2, f1 = seen.pair, seen.high(), seen.low(weights, n_fit, v_fit)
                out.append(summed(pd.DataFrame({"bucket": buckets(context), "q2": quant(f2), "q1": quant(f1), "n": 1, "s2": f2, "s1": f1})))
        return summed(pd.concat(out)) if out else pd.DataFrame(columns=[x.split()[0] for x in CELLS.split(", ")])

    return run


def _em(p: np.ndarray, n: np.ndarray, bucket: np.ndarray, steps: int, prior: float) -> np.ndarray:
    """Weights of the estimates in ``p``'s columns for each of 66 buckets; the last is for contexts that were seen."""
    even = np.full(p.shape[1], 1 / p.shape[1])

    def fit(pick: np.ndarray, start: np.ndarray, pull: float) -> np.ndarray:
        w = start
        for _ in range(steps):
            share = p[pick] * w
            share /= share.sum(1, keepdims=True)
            w = (share * n[pick, None]).sum(0) + pull * start
            w /= w.sum()
        return w

    out = np.tile(even, (66, 1))
    if len(n):
        overall = fit(np.ones(len(n), bool), even, 1e-9)
        for b in range(len(out)):
            pick = bucket == b
            out[b] = fit(pick, overall, prior) if pick.any() else overall
    out[0, -1] = 0
    return out / out.sum(1, keepdims=True)


def learn_weights(cells: pd.DataFrame, vocabulary: int, steps: int = 60, prior: float = 50.0) -> np.ndarray:
    """Weights (uniform, unigram, bigram) for each context bucket by expectation-maximisation.

    All buckets together are fitted first; that fit counts as ``prior`` tokens in each bucket, so that a
    bucket with few deleted tokens stays near it.  Without any deleted token the weights are equal.
    """
    n = cells["n"].to_numpy(float)
    p = np.stack((np.full(len(n), 1 / (vocabulary + 1)), cells["s1"].to_numpy(float) / n, cells["s2"].to_numpy(float) / n), 1)
    return _em(p, n, cells["bucket"].to_numpy(), steps, prior)


def learn_trust(cells: pd.DataFrame, steps: int = 60, prior: float = 50.0) -> np.ndarray:
    """Weights (lower estimates, trigram) for each bucket of the two words before, learned as by ``learn_weights``.

    They are learned where those words were seen; elsewhere the lower estimates have all the weight.
    """
    cells = cells[cells["bucket"] > 0]
    n = cells["n"].to_numpy(float)
    return _em(np.stack((cells["s1"].to_numpy(float) / n, cells["s2"].to_numpy(float) / n), 1), n, cells["bucket"].to_numpy(), steps, prior)


# ---------------------------------------------------------------- scores


def _score(spare: U, weights: np.ndarray, trust: np.ndarray, n_all: int, v_all: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c, total, cut in _with_answers(left, right, spare):
            total += cut
            del cut
            for texts in c.runs():
                lengths, held = c.lengths[texts], c.held[texts]
                low = int(c.starts[texts][0])
                tokens = slice(low, low + int(lengths.sum()))
                seen = _Seen(c, total, tokens)
                others = n_all - np.repeat(np.where(held, 0, lengths), lengths)
                add = lambda x: np.add.reduceat(x, c.starts[texts] - low)  # noqa: B023, E731
                score, apart = seen.probability(weights, trust, n_all, v_all), seen.without(c, texts, tokens).probability(weights, trust, others, v_all)
                out.append(pd.DataFrame({
                    "doc_id": pd.array(c.ids[texts], "Int64"), "held_out": held, "n_tokens": lengths, "n_known": add((seen.uni > 0).astype(np.int64)), "train_tokens": n_all,
                    "base_score": add(np.log10((seen.uni + 1) / (n_all + v_all + 1))), "score": add(np.log10(score)), "score_apart": add(np.log10(apart)),
                }))
        return pd.concat(out)

    return run


def score_texts(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fold: tuple[int, int] = (7, 2), deleted: int = 0, chunk_bytes: int = 1 << 23,
) -> DataFrame:
    """Score every text by a model of the training documents: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, score_apart``.

    A document is held out if crc32 of its id as text leaves ``fold[1]`` modulo ``fold[0]``; of the others,
    those that leave ``deleted`` teach the mixture weights, and the final counts are of all of them.  Tokens
    are words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end.  ``base_score`` is an add-one unigram score;
    ``score`` is the model's; both are sums of base-10 logarithms.  A training document counts itself in
    ``score``; ``score_apart`` leaves the document's own counts out, so that documents of both kinds compare
    and one that training holds twice stands out.  Of held-out documents the two are equal.

    A null or blank text is one end token.  A null id counts as the empty text in the fold and stays
    null.  Repeated rows are scored, and counted, each.  Without training documents all words are
    unknown and the scores are of the uniform distribution over one.  Other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ident = F.col(f"`{doc_id}`").cast("bigint")
    left_over = F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % fold[0]
    ready = docs.select(ident.alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), (left_over == fold[1]).alias("held"), ((left_over == deleted) & (left_over != fold[1])).alias("deleted"))
    stored = Stored(ready.mapInPandas(_tokenise(chunk_bytes), CHUNKS), "chunks").df
    n = stored.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 1_500_000))
    spare = _spare(n)
    asked = stored.mapInArrow(_ask(parts, spare), ASKED)
    answers = Stored(asked.repartition(parts, "part").groupBy("part").applyInPandas(lambda pdf: _answer(pdf, spare), ANSWER), "answers").df
    totals = answers.where("chunk = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_fit", "n_cut", "v_fit", "v_all")]).first()
    replies = answers.where("chunk >= 0").select("part", "chunk", "fit", "cut")
    teachers = stored.where("deleted")
    taught = teachers.groupBy("chunk").cogroup(replies.join(teachers.select("chunk"), "chunk", "left_semi").groupBy("chunk"))

    def cells(*known) -> pd.DataFrame:
        each = taught.applyInPandas(_cells(spare, totals["n_fit"], totals["v_fit"], *known), CELLS)
        return each.groupBy("bucket", "q2", "q1").agg(*[F.sum(c).alias(c) for c in ("n", "s2", "s1")]).toPandas()

    weights = learn_weights(cells(), totals["v_fit"])
    trust = learn_trust(cells(weights))
    both = stored.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    return both.applyInPandas(_score(spare, weights, trust, totals["n_fit"] + totals["n_cut"], totals["v_all"]), SCORES)
