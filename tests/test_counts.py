"""Counting and search against brute force over single rows."""

from __future__ import annotations

import numpy as np
import pytest

from bitspark.functions.codes import code_bits
from bitspark.operators import counts, kernels, search, sequence, sliced, transforms
from bitspark.operators.model import Model, sparse_weights
from bitspark.sources.bits import synthetic_rows

OUTPUTS = [0, 3, 200]


def brute_unit(x, y, n, m: Model, n_t, bits):
    w = (lambda v: v) if bits is None else (lambda v: v % (1 << bits))
    out = np.zeros((y.shape[1], x.shape[1], 2, n_t), np.int64)
    for o in range(y.shape[1]):
        used = np.flatnonzero(m.weight[o] >= 0)
        base = (x[:, used] ^ m.weight[o, used]).sum(1).astype(int)
        for i in range(x.shape[1]):
            for s in (0, 1):
                for t in range(n_t):
                    out[o, i, s, t] = 0 if m.weight[o, i] >= 0 else n[(w(base + (x[:, i] ^ s)) > w(m.threshold[o] + t)) == y[:, o]].sum()
    return out


def brute_exp(x, y, n, m, ci, cs, n_t, bits):
    return brute_exp_some(x, y, n, m, ci, cs, n_t, bits, range(1 << ci.shape[1]))


def brute_exp_some(x, y, n, m, ci, cs, n_t, bits, masks):
    w = (lambda v: v) if bits is None else (lambda v: v % (1 << bits))
    e = ci.shape[1]
    out = np.zeros((y.shape[1], len(masks), n_t), np.int64)
    for o in range(y.shape[1]):
        used = np.flatnonzero(m.weight[o] >= 0)
        base = (x[:, used] ^ m.weight[o, used]).sum(1).astype(int)
        for at, mask in enumerate(masks):
            pick = [k for k in range(e) if mask >> k & 1]
            v = w(base + (x[:, ci[o, pick]] ^ cs[o, pick]).sum(1).astype(int))
            for t in range(n_t):
                out[o, at, t] = n[(v > w(m.threshold[o] + t)) == y[:, o]].sum()
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 2, (64 * 3 + 7, 24), np.uint8), rng.integers(0, 2, (64 * 3 + 7, 5), np.uint8)
    x[:, 7] = 1  # a constant feature: ties
    y[:, 2] = 0  # a constant target
    m = Model.empty(24, 5)
    for o in range(5):
        for k in rng.choice(24, 6 if o < 4 else 15, replace=False):
            m.weight[o, k] = rng.integers(0, 2)
        m.threshold[o] = 1 + o
    return x, y, rng.integers(1, 9, len(x)), m


def block(x, y, n):
    return kernels.Block(kernels.Bits(x), n, n[:, None] * y.astype(np.int64))


@pytest.mark.parametrize("bits", [3, 4, 5, None])
def test_kernels_equal_brute_force(rows, bits):
    x, y, n, m = rows
    unit = kernels.unit_block(block(x, y, n), m, 2, bits)
    unit[m.weight >= 0] = 0
    assert (unit == brute_unit(x, y, n, m, 2, bits)).all()
    ci, cs = kernels.candidates(m, unit, 7)
    assert (kernels.exp_block(block(x, y, n), m, ci, cs, 3, bits) == brute_exp(x, y, n, m, ci, cs, 3, bits)).all()


def lanes(bits):
    full = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    full[:, : bits.shape[1]] = bits
    words = np.packbits(full, axis=1).view(">u8").astype(np.uint64)
    return words, sliced.lanes_of(words)[: bits.shape[1]]


@pytest.mark.parametrize("bits", [3, 4, 5, None])
@pytest.mark.parametrize("n", [1, 64, 192, 199])
def test_slices_equal_brute_force(rows, bits, n):
    """Planes, comparators and popcounts give the counts of single rows, wrapped or not, with a last lane that isn't full."""
    x, y, _, m = rows
    x, y, one = x[:n], y[:n], np.ones(n, np.int64)
    unit = sliced.unit_counts(lanes(x)[1], lanes(y)[1], n, m, 2, bits)
    unit[m.weight >= 0] = 0
    assert (unit == brute_unit(x, y, one, m, 2, bits)).all()
    ci, cs = kernels.candidates(m, unit, 7)
    assert (sliced.exp_counts(lanes(x)[1], lanes(y)[1], n, m, ci, cs, 3, bits) == brute_exp(x, y, one, m, ci, cs, 3, bits)).all()


def test_lanes_turn_back_and_apply(rows):
    x, _, _, m = rows
    words, _ = lanes(x)
    assert (sliced.rows_of(sliced.lanes_of(words), len(words)) == words).all()
    wide = Model.empty(64, 64)
    wide.weight[:5, :24], wide.threshold[:5] = m.weight, m.threshold
    out = np.unpackbits(sliced.apply(words, wide).astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1)
    assert (out[:, :5] == kernels.predict(m, x)).all() and (out[:, 5:] == 0).all()
    wide.threshold[9] = -1  # exceeded by nothing but a sum of nothing
    a = np.random.default_rng(0).integers(0, 2**63, (300, 200)).astype(np.uint64)
    one = np.unpackbits(a.view(np.uint8), axis=1).astype(np.int64)
    assert (sliced.common(a[:40], a[40:]) == one[:40] @ one[40:].T).all()


@pytest.mark.parametrize("e", range(1, 11))
def test_subset_ranks(e):
    rng = np.random.default_rng(e)
    a = rng.integers(-50, 50, (2, 1 << e))
    got = transforms.subset_ranks(a)
    for mask in {0, 1, (1 << e) - 1, *rng.integers(0, 1 << e, 5).tolist()}:
        inside = np.bitwise_count(np.arange(1 << e) & mask)
        for k in range(e + 1):
            assert (got[:, mask, k] == a[:, inside == k].sum(1)).all()


@pytest.mark.parametrize("e", [1, 4, 10])
def test_exp_counts_of_other_numbers_of_candidates(rows, e):
    x, y, n, m = rows
    m = Model(m.weight.copy(), m.threshold)
    m.weight[4, 8:] = -1  # leaves enough to choose from
    ci = np.stack([np.flatnonzero(w < 0)[:e] for w in m.weight])
    cs = np.random.default_rng(e).integers(0, 2, ci.shape).astype(np.uint8)
    for bits in (3, None):
        assert (kernels.exp_block(block(x, y, n), m, ci, cs, 3, bits)[:, :: 1 << max(0, e - 5)] == brute_exp_some(x, y, n, m, ci, cs, 3, bits, range(0, 1 << e, 1 << max(0, e - 5)))).all()


def test_transforms_of_codes():
    rng = np.random.default_rng(5)
    book = code_bits().astype(np.int64)
    h = rng.integers(0, 1000, (256, 3))
    assert (transforms.ones_of(h) == book.T @ h).all()
    bits = np.concatenate((rng.integers(0, 2, (500, 256)), book, 1 - book)).astype(np.uint8)
    distance = (bits[:, None, :] != book[None].astype(np.uint8)).sum(2)
    assert (transforms.nearest(bits, 100) == distance.argmin(1)).all()


def test_first_layers_by_transform_equal_bits():
    """Bytes kept as bytes count like their code bits."""
    rng = np.random.default_rng(6)
    data, follow = rng.integers(0, 256, (300, 2)), rng.integers(0, 256, 300)
    n = rng.integers(1, 9, 300)
    m = Model.empty()
    for o in range(256):
        m.weight[o, rng.choice(512, 6, replace=False)] = rng.integers(0, 2, 6)
        m.threshold[o] = rng.integers(0, 4)
    codes = kernels.Block(kernels.Codes(data), n, n[:, None] * code_bits()[follow].astype(np.int64))
    plain = kernels.Block(kernels.Bits(kernels.features(data, [])), n, codes.ones)
    assert (kernels.predict(m, codes.inputs) == kernels.predict(m, plain.inputs)).all()
    unit = kernels.unit_block(codes, m, 2, 4)
    assert (unit == kernels.unit_block(plain, m, 2, 4)).all()
    ci, cs = kernels.candidates(m, unit)
    assert (kernels.exp_block(codes, m, ci, cs, 3, 4) == kernels.exp_block(plain, m, ci, cs, 3, 4)).all()


def test_wrap_around_differs_from_exact(rows):
    x, y, n, m = rows
    assert (kernels.unit_block(block(x, y, n), m, 2, 3) != kernels.unit_block(block(x, y, n), m, 2, None)).any()


def test_signs_are_complements_without_a_filter(rows):
    x, y, n, _ = rows
    unit = kernels.unit_block(block(x, y, n), Model.empty(24, 5), 1, None)
    assert (unit[:, :, 0, 0] + unit[:, :, 1, 0] == n.sum()).all()


@pytest.fixture(scope="module")
def trigrams(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 4")
    return sequence.distinct_windows(docs, 3)


@pytest.mark.parametrize("bits", [3, 4, None])
def test_sql_counts_equal_kernels(spark, trigrams, bits):
    from bitspark.plans.perf import test_model

    full = test_model()
    m = Model(full.weight[OUTPUTS], full.threshold[OUTPUTS])
    weights, thresholds = full.to_tables(spark)
    weights, thresholds = weights.where(weights.o.isin(OUTPUTS)), thresholds.where(thresholds.o.isin(OUTPUTS))
    pdf = trigrams.toPandas()
    ctx = sequence.unpack(trigrams, 3)
    blocks = [kernels.Block(b.inputs, b.n, b.ones[:, OUTPUTS]) for b in kernels.window_reader([])(pdf)]
    unit = sum(kernels.unit_block(b, m, 2, bits) for b in blocks)
    unit[m.weight >= 0] = 0
    table = counts.unit_counts(counts.base_sums(ctx, weights, OUTPUTS, bits), weights, thresholds, 2, bits)
    got = {(r.o, r.i, r.s, r.t): r["count"] for r in table.collect()}
    assert got == {(o, i, s, t): int(unit[k, i, s, t]) for k, o in enumerate(OUTPUTS) for i in range(512) for s in (0, 1) for t in (0, 1)}
    ci, cs = kernels.candidates(m, unit)
    cand = search.exp_candidates(table, weights)
    search.require_candidates(cand, 7)
    assert {(r.o, r.slot): (r.i, r.s) for r in cand.collect()} == {(o, j): (int(ci[k, j]), int(cs[k, j])) for k, o in enumerate(OUTPUTS) for j in range(7)}
    exp = sum(kernels.exp_block(b, m, ci, cs, 3, bits) for b in blocks)
    table = counts.exp_counts(counts.patterns(ctx, weights, cand, OUTPUTS, bits), thresholds, 7, 3, bits)
    assert {(r.o, r.mask, r.t): r["count"] for r in table.collect()} == {(o, q, t): int(exp[k, q, t]) for k, o in enumerate(OUTPUTS) for q in range(128) for t in range(3)}
    new, accuracy = kernels.update(m, ci, cs, exp)
    chosen = search.choose(table, weights, thresholds)
    w2, t2 = search.update_filters(chosen, cand, weights)
    assert {r.o: r.accuracy for r in chosen.collect()} == {o: int(accuracy[k]) for k, o in enumerate(OUTPUTS)}
    assert {(r.o, r.i, r.s) for r in w2.collect()} == {(o, int(i), int(new.weight[k, i])) for k, o in enumerate(OUTPUTS) for i in np.flatnonzero(new.weight[k] >= 0)}
    assert {r.o: r.threshold for r in t2.collect()} == {o: int(new.threshold[k]) for k, o in enumerate(OUTPUTS)}


def test_tie_rules(spark):
    unit = spark.createDataFrame([(0, i, s, t, 10) for i in range(9) for s in (0, 1) for t in (0, 1)], "o int, i int, s int, t int, count bigint")
    none = spark.createDataFrame([], "o int, i int, s int")
    cand = search.exp_candidates(unit, none).orderBy("slot").collect()
    assert [(r.i, r.s) for r in cand] == [(i, 1) for i in range(7)]  # the lower feature and the negated sign
    rows = [(0, m, t, 5) for m in range(128) for t in range(3)]
    zero = spark.createDataFrame([(0, 4)], "o int, threshold int")
    won = search.choose(spark.createDataFrame(rows, "o int, mask int, t int, count bigint"), none, zero).first()
    assert (won.mask, won.threshold) == (0, 4)  # fewest candidates, lowest threshold
    rows = [(0, m, t, 5 if m in (1, 2, 4) else 1) for m in range(8) for t in range(3)]
    assert search.choose(spark.createDataFrame(rows, "o int, mask int, t int, count bigint"), none, zero).first().mask == 4  # then the larger number
    full = spark.createDataFrame([(0, i, 0) for i in range(14)], "o int, i int, s int")
    rows = [(0, m, 0, m) for m in range(8)]
    assert search.choose(spark.createDataFrame(rows, "o int, mask int, t int, count bigint"), full, zero).first().mask == 4  # at most 15 weights


def test_too_few_candidates(spark):
    m = Model.empty(10, 1)
    m.weight[0, :4] = 0
    with pytest.raises(ValueError):
        kernels.candidates(m, np.ones((1, 10, 2, 2), np.int64))
    short = spark.createDataFrame([(0, k, k, 0) for k in range(6)], "o int, slot int, i int, s int")
    with pytest.raises(ValueError):
        search.require_candidates(short, 7)


def test_packed_rows(spark):
    m = Model.empty(128, 64)
    m.weight[:, 5], m.weight[:, 9] = 0, 1
    rows = synthetic_rows(spark, 300, 2, 1)
    pdf = rows.toPandas()
    bits = lambda c: np.unpackbits(np.stack(pdf[c].to_numpy()).astype(">i8").view(np.uint8), axis=1)
    want = kernels.unit_block(block(bits("x"), bits("y"), np.ones(300, np.int64)), m, 2, 4)
    want[m.weight >= 0] = 0
    ci, cs = kernels.candidates(m, want)
    exp = kernels.exp_block(block(bits("x"), bits("y"), np.ones(300, np.int64)), m, ci, cs, 3, 4)
    for read in (kernels.row_reader(), kernels.lane_reader()):
        assert (kernels.unit_cube(rows, read, m, 2, 4) == want).all()
        assert (kernels.exp_cube(rows, read, m, ci, cs, 3, 4) == exp).all()


def test_search_where_the_counts_are(spark, monkeypatch):
    """Blocks of outputs, candidates and winners found on executors equal the search over whole cubes."""
    rng = np.random.default_rng(8)
    m = Model.empty(256, 128)
    for o in range(128):
        m.weight[o, rng.choice(256, 5, replace=False)] = rng.integers(0, 2, 5)
    rows = synthetic_rows(spark, 500, 4, 2)
    unit = kernels.unit_cube(rows, kernels.row_reader(), m, 2, 4)
    ci, cs = kernels.candidates(m, unit)
    want, accuracy = kernels.update(m, ci, cs, kernels.exp_cube(rows, kernels.row_reader(), m, ci, cs, 3, 4))
    for read in (kernels.row_reader(), kernels.lane_reader()):
        monkeypatch.setattr(kernels, "CUBE_BYTES", 256 * 2 * 2 * 8 * 50)  # three blocks of outputs
        table = kernels.unit_table(rows, read, m, 2, 4)
        got_i, got_s = kernels.search_candidates(table, m)
        assert (got_i == ci).all() and (got_s == cs).all()
        new, right = kernels.search_update(kernels.exp_table(rows, read, m, ci, cs, 3, 4), m, ci, cs)
        assert (new.weight == want.weight).all() and (new.threshold == want.threshold).all() and (right == accuracy).all()
    each = {(r.o, r.i, r.s, r.t): r["count"] for r in kernels.count_rows(table, (256, 2, 2), ["i", "s", "t"]).where("o % 50 = 3").collect()}
    assert each == {(o, i, s, t): int(unit[o, i, s, t]) for o in (3, 53, 103) for i in range(256) for s in (0, 1) for t in (0, 1)}
    full = Model.empty(64, 64)
    full.weight[0, :60] = 0
    with pytest.raises(ValueError):
        kernels.search_candidates(table, full)


def test_search_over_a_wide_layer(spark):
    """4,096 inputs and 1,024 outputs: outputs are counted in two blocks, and only candidates reach the driver."""
    rng = np.random.default_rng(9)
    m = Model.empty(4096, 1024)
    for o in range(1024):
        m.weight[o, rng.choice(4096, 3, replace=False)] = rng.integers(0, 2, 3)
    m.threshold[:] = 1
    rows = synthetic_rows(spark, 150, 64, 16)
    got_i, got_s = kernels.search_candidates(kernels.unit_table(rows, kernels.row_reader(), m, 2, 4), m)
    pdf = rows.toPandas()
    bits = lambda c: np.unpackbits(np.stack(pdf[c].to_numpy()).astype(">i8").view(np.uint8), axis=1)
    some = [0, 511, 512, 1023]
    part = Model(m.weight[some], m.threshold[some])
    unit = kernels.unit_block(block(bits("x"), bits("y")[:, some], np.ones(150, np.int64)), part, 2, 4)
    unit[part.weight >= 0] = 0
    want_i, want_s = kernels.candidates(part, unit)
    assert (got_i[some] == want_i).all() and (got_s[some] == want_s).all()


def test_sparse_form_lists_empty_filters(spark):
    weights = spark.createDataFrame([(1, 7, 1), (1, 2, 0)], "o int, i int, s int")
    thresholds = spark.createDataFrame([(0, 0), (1, 3)], "o int, threshold int")
    rows = {r.o: ([(t.i, t.s) for t in r.terms], r.thresholds) for r in sparse_weights(weights, thresholds).collect()}
    assert rows == {0: ([], [0, 1]), 1: ([(2, 0), (7, 1)], [3, 4])}


def test_code_features_match_the_reader():
    x = kernels.features(np.array([[65, 66]]), [])
    book = code_bits()
    assert (x[0] == np.concatenate((book[65], book[66]))).all()


def test_whole_lanes_drop_the_remainder(spark):
    from bitspark.operators.counts import whole_lanes

    df = spark.range(64 * 3 + 7).withColumnRenamed("id", "row_id")
    assert whole_lanes(df, 64).count() == 192 and whole_lanes(df, 512).count() == 0 and whole_lanes(df, 1).count() == 199
    with pytest.raises(ValueError):
        whole_lanes(df, 0)


def test_sums_over_subsets_take_little_space(monkeypatch):
    """A whole layer's exp counts are made a few outputs at a time."""
    import tracemalloc

    rng = np.random.default_rng(5)
    weight = np.full((256, 512), -1, np.int8)
    weight[:, :15] = 1
    model = Model(weight, rng.integers(0, 9, 256))
    cells = rng.integers(-1000, 1000, (256, (16 << 7) + 1))
    tracemalloc.start()
    got = kernels.exp_of_cells(cells, model, 7, 3, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    monkeypatch.setattr(kernels, "RANKS", 1 << 22)
    assert (got == kernels.exp_of_cells(cells, model, 7, 3, 4)).all()


def test_counts_are_added_out_of_arrow():
    """Batches are let go once they are added; outputs in several batches are added up."""
    import pyarrow as pa

    size, before, most = 1 << 17, pa.total_allocated_bytes(), []

    def batches():
        for k in range(6):
            yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2 + k % 2], pa.int32()), pa.array([np.full(size, v, np.int64).tobytes() for v in (k, 1, 10)])], names=["o", "counts"])
            most.append(pa.total_allocated_bytes() - before)

    out = {b.column("o")[0].as_py(): np.frombuffer(b.column("counts")[0].as_buffer(), np.int64) for b in kernels._add(batches())}
    assert {o: (len(v), set(v.tolist())) for o, v in out.items()} == {0: (size, {15}), 1: (size, {6}), 2: (size, {30}), 3: (size, {30})}
    assert max(most) < 3 * 3 * size * 8
