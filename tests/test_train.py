"""Windows, training, files, performance records, streams and the entry points."""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pytest

from bitspark.functions.codes import code_bits
from bitspark.operators import kernels, layer, sequence
from bitspark.operators.model import Model, dense_weights
from bitspark.operators.transpose import block_transpose
from bitspark.plans import perf, train
from bitspark.sources import bits as sources

TEXTS = [None, "", "a", "ab", "abcabcab", "héé→", "x" * 50]


def windows_of(texts, width):
    out = Counter()
    for t in texts:
        raw = (t or "").encode()
        out.update(raw[i : i + width] for i in range(len(raw) - width + 1))
    return out


def as_counter(df, width):
    rows = df.collect()
    out = Counter({int(r.code).to_bytes(width, "big") if width <= 7 else bytes(r.code): r.n for r in rows})
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 9, 17])
def test_distinct_windows(spark, width, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    for held in (sequence.HELD, 3):
        monkeypatch.setattr(sequence, "HELD", held)
        for near in (False, True):
            assert as_counter(sequence.distinct_windows(df, width, by_context=near), width) == windows_of(TEXTS, width)
    if width > 1:
        first = sequence.unpack(sequence.distinct_windows(df, width), width).agg({"b0": "max", f"b{width - 1}": "min"}).first()
        want = windows_of(TEXTS, width)
        assert (first["max(b0)"], first[f"min(b{width - 1})"]) == (max(w[0] for w in want), min(w[-1] for w in want))
    if width == 3:
        rows = sequence.windows(sequence.utf8_bytes(df), 3).collect()
        assert Counter(bytes((r.b0, r.b1, r.b2)) for r in rows) == windows_of(TEXTS, 3)


@pytest.mark.parametrize("width", [8, 10, 30])
def test_wide_windows_move_as_runs(spark, width):
    """Windows beside each other share a run of bytes: what moves is less than half of what the windows would be."""
    rng = np.random.default_rng(width)
    words = ["".join(map(chr, rng.integers(97, 105, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 400)) for _ in range(20)] + ["a" * 1000, "short", "x" * width, "é" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    made = sequence.distinct_windows(df, width)
    assert as_counter(made, width) == windows_of(texts, width)
    exchanges = [x for x in made._jdf.queryExecution().executedPlan().toString().split("\n") if " Exchange " in x]
    assert exchanges and all("hashpartitioning(cell" in x for x in exchanges)
    pieces = [np.frombuffer(t.encode(), np.uint8) for t in texts if len(t.encode()) >= width]
    runs = sequence._runs_of(pieces, width, 1000).column("run").to_pylist()
    windows = [r[i : i + width] for r in runs for i in range(len(r) - width + 1)]
    assert set(windows) == set(windows_of(texts, width)) and sum(map(len, runs)) < len(windows) * width / 2
    assert max(map(len, runs)) <= sequence.RUN + width - 1


@pytest.mark.parametrize("width", [7, 10])
def test_a_task_holds_few_windows(width):
    """Windows that don't collapse leave a task in small frames; what it holds does not grow with them."""
    import tracemalloc

    tracemalloc.start()
    own, n, longest = sequence._Windows(width), 0, 0
    for seed in range(6):
        for made in own.add(np.random.default_rng(seed).integers(0, 256, 1_500_000, np.uint8)):
            n, longest = n + int(made["n"].sum()), max(longest, len(made))
    for made in own.rows():
        n, longest = n + int(made["n"].sum()), max(longest, len(made))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 6 * (1_500_000 - width + 1) and longest <= 1 << 16 and peak < 300 << 20


def test_putting_windows_together_takes_little_space():
    """Adding windows to those held needs space for the new ones and one copy, and nothing stays of what has left."""
    import tracemalloc

    own, rng, n = sequence._Windows(7), np.random.default_rng(3), 0
    first, second = (rng.integers(0, 256, size, np.uint8) for size in (1_900_000, 1_000_000))
    assert not list(own.add(first))
    own.merge()
    tracemalloc.start()
    given = [*own.add(second), *own.rows()]
    peak = tracemalloc.get_traced_memory()[1] - sum(m["n"].to_numpy().nbytes for m in given)
    tracemalloc.stop()
    n = sum(int(m["n"].sum()) for m in given)
    assert n == len(first) + len(second) - 12 and peak < 110 << 20
    assert all(a.base is None for a in (own.codes, own.counts))


def test_sorted_runs_are_joined():
    rng = np.random.default_rng(4)
    for sizes in ((0, 5), (5, 0), (40, 60), (300, 30), (1, 1)):
        both = [Counter(rng.integers(-50, 50, s).tolist()) for s in sizes]
        a, b = ((np.array(sorted(c), np.int64), np.array([c[k] for k in sorted(c)], np.int64)) for c in both)
        codes, counts = sequence._joined(*a, *b)
        want = both[0] + both[1]
        assert codes.tolist() == sorted(want) and counts.tolist() == [want[k] for k in sorted(want)]


def test_windows_of_texts_stay_where_they_are(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(1, "again and again"), (None, "no id"), (3, None)], "doc_id bigint, text string")
    for width in (1, 2, 3, 5):
        made = sequence.text_windows(df, width)
        want = Counter((r.doc_id, i, (r.text or "").encode()[i : i + width]) for r in df.collect() for i in range(len((r.text or "").encode()) - width + 1))
        assert Counter((r[0], r[1], bytes(r[2:])) for r in made.collect()) == want
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


@pytest.mark.parametrize("width", [1, 2, 3, 9])
@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_a_table_as_one_stream(spark, width, partitions):
    """Windows that cross rows and partitions, with rows and partitions shorter than a window."""
    texts = [None, "", "a", "ab", "abcabcab", "héé→", "x" * 50, "", "y", "z", "abcabc", "q" * 3, None, "end"] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    whole = "".join(t or "" for t in texts)
    got = sequence.stream_windows(sequence.table_stream(df, ["doc_id"], partitions=partitions), width)
    assert as_counter(got, width) == windows_of([whole], width)
    assert as_counter(sequence.stream_windows(sequence.table_stream(df.where("doc_id < 0"), ["doc_id"]), width), width) == Counter()


@pytest.mark.parametrize("split", ["40b", "1000b", "1m"])
def test_files_in_splits(spark, tmp_path, split):
    """Files read by ranges count like files in one piece, whatever their bytes and however they end."""
    rng = np.random.default_rng(1)
    files = [b"", b"\n", b"no end", b"one\ntwo\n", b"\n\n\nx", b"a\r\nb\rc\n\n", bytes(rng.integers(0, 256, 3000, np.uint8)), b"long " * 500 + b"\n" + b"y" * 700, b"ab\n" * 200]
    for k, raw in enumerate(files):
        (tmp_path / f"f{k}.bin").write_bytes(raw)
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        places = sequence.file_stream(spark, str(tmp_path)).select("stream", "place").distinct().count()
        assert places >= (25 if split == "40b" else 8)  # an empty file has none
        for width in (1, 3, 10):
            want = Counter()
            for raw in files:
                want.update(raw[i : i + width] for i in range(len(raw) - width + 1))
            assert as_counter(sequence.file_windows(spark, str(tmp_path), width), width) == want
            short = Counter()
            for raw in files:
                short.update(raw[i : i + width] for i in range(len(raw) - width + 1) if i < 130)
            assert as_counter(sequence.file_windows(spark, str(tmp_path), width, 130), width) == short
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_zip_by_place(spark):
    import random

    from bitspark.operators import positional

    r = random.Random(2)
    a, b = [(r.random(), k, "x") for k in range(200)], [(k, f"r{k}") for k in range(150)]
    left = spark.createDataFrame(r.sample(a, len(a)), "v double, number int, row string").repartition(7)
    right = spark.createDataFrame(r.sample(b, len(b)), "k int, s string").repartition(4)
    got = {x.number: (x.left.number, x.right.s) for x in positional.zipped(left, ["v"], right, ["k"]).collect()}
    assert got == {k: (row[1], f"r{k}") for k, row in enumerate(sorted(a)[:150])}
    assert {x.number: x.v for x in positional.enumerated(left, ["v"]).collect()} == {k: row[0] for k, row in enumerate(sorted(a))}
    runs = positional.chunks(right, ["k"], 64, rest=False).collect()
    assert {(x.chunk, x.place): x.row.k for x in runs} == {(k // 64, k % 64): k for k in range(128)}
    assert positional.chunks(right, ["k"], 64).count() == 150 and positional.zipped(left.where("v > 2"), ["v"], right, ["k"]).count() == 0
    with pytest.raises(ValueError):
        positional.chunks(right, ["k"], 0)
    ties = spark.createDataFrame([(1,), (None,), (1,), (None,)], "k int")
    assert sorted(x.number for x in positional.numbered(ties, ["k"], 3).collect()) == [0, 1, 2, 3]


def test_training_goes_on_where_it_ended(spark, tmp_path, monkeypatch):
    text = " ".join("the cat sat on the mat and the dog ran to the red barn".split() * 4)
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    want, reports = train.train_stack(df, layers=2, iterations=3)
    write, made = train.Ledger.write, []

    def failing(self, layer, iteration, *rest):
        write(self, layer, iteration, *rest)
        made.append((layer, iteration))
        if len(made) == 2:
            (tmp_path / "ledger/layer=1/iteration=2").mkdir()  # what a lost run may leave
            raise RuntimeError("lost")

    monkeypatch.setattr(train.Ledger, "write", failing)
    with pytest.raises(RuntimeError, match="lost"):
        train.train_stack(df, layers=2, iterations=3, ledger=str(tmp_path / "ledger"))
    got, again = train.train_stack(df, layers=2, iterations=3, ledger=str(tmp_path / "ledger"))
    assert made == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]  # nothing was done twice
    assert all((a.weight == b.weight).all() and (a.threshold == b.threshold).all() for a, b in zip(got, want, strict=True)) and again == reports


def test_training_improves_and_repeats(spark):
    text = " ".join("the cat sat on the mat and the dog ran to the red barn".split() * 8)
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    models, reports = train.train_stack(df, layers=2)
    again, _ = train.train_stack(df, layers=1)
    assert (models[0].weight == again[0].weight).all() and (models[0].threshold == again[0].threshold).all()
    assert len(reports) == 2 and reports[0].bit_accuracy == sorted(reports[0].bit_accuracy) and (models[0].n_set <= 15).all()
    assert reports[0].windows == len(text) - 2 and reports[0].accuracy > Counter(text).most_common(1)[0][1] / len(text)
    table = train.report_table(spark, reports)
    assert table.count() == 2


def test_layer_one_against_a_plain_loop(spark):
    """One iteration of one layer equals counting row by row."""
    text = "abracadabra simsalabim " * 4
    df = spark.createDataFrame([(text,)], "text string")
    rows = sequence.distinct_windows(df, 3)
    model, history = train.fit_layer(rows, kernels.window_reader([]), iterations=1)
    book, raw = code_bits(), np.frombuffer(text.encode(), np.uint8)
    x, y = np.concatenate((book[raw[:-2]], book[raw[1:-1]]), 1), book[raw[2:]]
    rows_of = kernels.Block(kernels.Bits(x), np.ones(len(x), np.int64), y.astype(np.int64))
    empty = Model.empty()
    unit = kernels.unit_block(rows_of, empty, 2, 4)
    ci, cs = kernels.candidates(empty, unit)
    want, accuracy = kernels.update(empty, ci, cs, kernels.exp_block(rows_of, empty, ci, cs, 3, 4))
    assert (model.weight == want.weight).all() and (history[0] == accuracy).all()


def test_file_training_and_short_files(spark, tmp_path):
    path = tmp_path / "text.bin"
    path.write_bytes(b"to be or not to be that is the question " * 20)
    _, reports = train.train_file(spark, str(path), 256, layers=1)
    assert reports[0].windows == 798 and reports[0].accuracy == reports[0].correct / 799
    with pytest.raises(ValueError):
        train.train_file(spark, str(path), 1 << 20, layers=1)
    path.write_bytes(b"")
    with pytest.raises(ValueError):
        train.train_file(spark, str(path), None, layers=1)


def test_sql_layer_equals_kernel(spark):
    from pyspark.sql import functions as F

    from bitspark.functions.bits import flatten_2d
    from bitspark.functions.codes import decode, encode_byte

    m = perf.test_model()
    weights, thresholds = m.to_tables(spark)
    pairs = spark.createDataFrame([(a, b) for a in (0, 65, 200) for b in (1, 255)], "b0 int, b1 int").withColumn("x", flatten_2d(encode_byte("b0"), encode_byte("b1")))
    got = decode(layer.apply_layer(pairs, dense_weights(weights), thresholds), "out").collect()
    for r in got:
        want = kernels.predict(m, kernels.features(np.array([[r.b0, r.b1]]), []))
        assert [int(w) for w in np.packbits(want).view(">i8").astype(np.int64)] == r.out and r.decoded == kernels.decode_bits(want)[0]
    s = layer.sparsity(weights).first()
    assert s.n_set == m.n_set.sum() and abs(s.sparsity - m.sparsity) < 1e-12
    hits = spark.createDataFrame([(1, 1, 5), (2, 3, 4)], "decoded int, label int, n bigint")
    assert layer.accuracy(hits, unlabelled=1).first().asDict() == {"correct": 5, "total": 10, "accuracy": 0.5}
    assert layer.accuracy(hits.where(F.lit(False))).first().total == 0


def test_stackable_layers(spark):
    """Explicit rows: windows, targets and bytes move on by one for each layer, and training on them equals collapsed windows."""
    from bitspark.plans import stack

    texts = ["the cat sat on the mat " * 6, "abcd", "ab", "a", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows, models = stack.byte_rows(df), []
    for depth in (1, 2, 3):
        rows, m, report = stack.stackable_layer(rows, iterations=2)
        models.append(m)
        got = {(r.doc_id, r.pos): (r.x, r.byte) for r in rows.collect()}
        want = {}
        for d, t in enumerate(texts):
            raw = np.frombuffer((t or "").encode(), np.uint8)
            for k in range(len(raw) - depth - 1):
                bits = kernels.predict(m, kernels.features(raw[None, k : k + depth + 1], models[:-1]))
                want[d, k] = (np.packbits(bits).view(">i8").astype(np.int64).tolist(), int(raw[k + depth + 1]))
        assert got == want and report.first().total == len(want)
    collapsed, _ = train.train_stack(df, layers=3, iterations=2)
    assert all((a.weight == b.weight).all() and (a.threshold == b.threshold).all() for a, b in zip(models, collapsed, strict=True))


def test_seven_layers_on_wide_windows(spark):
    """Collapsed windows of up to nine bytes grow the same filters as explicit rows."""
    from bitspark.plans import stack

    df = spark.createDataFrame([(1, "the cat sat on the mat and the dog ran " * 3), (2, "to the red barn " * 4)], "doc_id bigint, text string")
    rows, explicit = stack.byte_rows(df), []
    for _ in range(7):
        rows, m, _ = stack.stackable_layer(rows, iterations=1)
        explicit.append(m)
    collapsed, reports = train.train_stack(df, layers=7, iterations=1)
    assert [r.layer for r in reports] == list(range(1, 8))
    assert all((a.weight == b.weight).all() and (a.threshold == b.threshold).all() for a, b in zip(explicit, collapsed, strict=True))


def test_transpose_drops_the_remainder(spark):
    rows = spark.createDataFrame([(i, [i]) for i in range(64 + 7)], "row_id bigint, words array<bigint>")
    got = block_transpose(rows, 64).collect()
    assert {r.block for r in got} == {0} and len(got) == 64
    lanes = {r["column"]: r.lane & (1 << 64) - 1 for r in got}
    assert lanes[63] == int("01" * 32, 2) and lanes[0] == 0


def test_models_and_records_round_trip(spark, tmp_path):
    m = perf.test_model()
    sources.save_model(spark, m, str(tmp_path / "m"))
    back = sources.load_model(spark, str(tmp_path / "m"))
    assert (back.weight == m.weight).all() and (back.threshold == m.threshold).all()
    records = perf.run_tests(spark, 12, (1,), (3, None))
    sources.write_perf(records, str(tmp_path / "p"))
    again = sources.read_perf(spark, str(tmp_path / "p"))
    assert again.first().tests[0].unit_hash == records.first().tests[0].unit_hash
    points = perf.perf_points(again)
    assert [(r.precision, r.x) for r in points.collect()] == [(3, 1)]
    assert perf.render_svg(points, 3000).count("<circle") == 1
    assert perf.trimmed(1 << 20, 5) == (4095, (1 << 20) // 4095 * 4095)


@pytest.mark.parametrize("width", [2, 9])
def test_stream_counts_equal_batch_counts(spark, tmp_path, width):
    """Micro-batches, put together now and then, count like one batch; a sum that was not finished doesn't count."""
    from bitspark.streaming.counters import compact, count_windows, windows_so_far

    texts, sink = ["abcabcabcabc", "bcabcaabcabcabc", "", "x" * 12, "abcabcabca"], str(tmp_path / "out")
    assert windows_so_far(spark, sink, width).count() == 0
    for k, t in enumerate(texts):
        spark.createDataFrame([(t,)], "text string").write.parquet(str(tmp_path / "in"), mode="append" if k else "overwrite")
        stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
        count_windows(stream, width, sink, str(tmp_path / "cp")).awaitTermination()
        if k in (2, 4):
            compact(spark, sink, width)
            compact(spark, sink, width)
            assert len(list((tmp_path / "out").glob("*=*/_SUCCESS"))) == 1
        if k == 3:
            (tmp_path / "out" / "upto=3").mkdir()  # what a lost run may leave
        assert as_counter(windows_so_far(spark, sink, width), width) == windows_of(texts[: k + 1], width)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from bitspark import __main__ as cli

    assert cli.main([]) == 2 and cli.main(["grow", "1", "x"]) == 2 and "train EXPONENT FILE" in capsys.readouterr().out
    (tmp_path / "t").write_bytes(b"to be or not to be " * 20)
    one = train.train_file(spark, str(tmp_path / "t"), 1 << 7, layers=1, iterations=1)[1]
    monkeypatch.setattr(train, "train_file", lambda s, path, n: (None, one if (path, n) == (str(tmp_path / "t"), 1 << 7) else []))
    assert cli.main(["train", "7", str(tmp_path / "t")]) == 0
    assert capsys.readouterr().out == f"layer 1: accuracy {100 * one[0].accuracy:.3f}%, sparsity {100 * one[0].sparsity:.3f}%\n"
    records = perf.run_tests(spark, 12, (1,), (3, 4))
    monkeypatch.setattr(perf, "run_tests", lambda s, n: records if n == 12 else None)
    assert cli.main(["perf", "12", str(tmp_path / "r")]) == 0 and cli.main(["plot", "9000", str(tmp_path / "r"), str(tmp_path / "o.svg")]) == 0
    assert spark.read.text(str(tmp_path / "o.svg"), wholetext=True).first().value.count("<circle") == 2


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["o", "slot", "i", "s"] and entry.entry(spark).count() == 256 * 7
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_oracle_agrees_on_the_smallest_tables(spark, sf):
    """Rows of every query that has SQL, over whole tables."""
    import duckdb

    from bitspark import queries

    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{sf}/{name}')")
    sql, made = queries.oracle_sql(), queries.queries()
    for name in ("word_bits", "encode_bytes", "bitslice_add", "unit_counts_labels", "exp_candidates", "update_filters", "layer_accuracy", "dense_weights", "stream_contexts", "wide_windows", "file_contexts", "positional_zip", "chunked_rows", "unit_counts_lanes", "exp_counts_lanes", "coded_keys", "decoded_keys", "sold_filters", "sold_sparsity", "sold_records", "compare_planes", "set_rows"):
        df = made[name](spark, sf)
        cols = sorted(df.columns)
        rel = con.sql(sql[name])
        at = [rel.columns.index(c) for c in cols]
        assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, (tuple(r[k] for k in at) for r in rel.fetchall()))), name
