"""The registered queries of the engine itself, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitspark.functions import bits, codes, lanes
from bitspark.operators import counts, kernels, layer, model, positional, sequence, transpose
from bitspark.plans import perf, stack, train
from bitspark.sources.shared import stored

Query = Callable[[SparkSession, str], DataFrame]
PRECISIONS = (3, 4, 5, None)
E = 7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- words, lanes, codes


def word_bits(spark, d):
    k = F.col("o_orderkey")
    flipped = bits.set_bit(bits.set_bit(k, 5, True), k % 64, False)
    return _table(spark, d, "orders").select(
        "o_orderkey", bits.count_ones(k).alias("ones"), bits.get_bit(k, 60).alias("bit60"), bits.get_bit_u8(k, k % 64).alias("bit_at"), bits.count_ones(flipped).alias("ones_set"),
        bits.display(flipped).alias("shown"), k.bitwiseXOR(F.lit(21)).alias("x"), k.bitwiseAND(F.lit(21)).alias("a"), k.bitwiseOR(F.lit(21)).alias("r"), bits.count_ones(F.bitwise_not(k)).alias("ones_not"),
    )


def _sign_words(spark, d):
    """``vec_id, words``: whether each element is positive, first element at the most significant bit."""
    e = _table(spark, d, "embeddings")
    n = 64
    word = F.aggregate(F.slice("embedding", 1, n), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))
    return e.select("vec_id", "label", word.alias("word"))


def word_hamming(spark, d):
    v = _sign_words(spark, d)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("word").alias("w2"))
    return v.join(nxt, "vec_id").select("vec_id", bits.hamming(F.array("word"), F.array("w2")).alias("distance"), bits.count_ones("word").alias("ones"))


def masked_hamming(spark, d):
    v = _sign_words(spark, d)
    filters = model.dense_weights(model.test_filters(spark, list(range(1, 17)), 64), 64)
    return v.crossJoin(F.broadcast(filters)).select("vec_id", "o", bits.masked_hamming(F.array("word"), "sign", "mask").alias("distance"))


def flatten_pairs(spark, d):
    v = _sign_words(spark, d)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("word").alias("w2"))
    flat = v.join(nxt, "vec_id").withColumn("flat", bits.flatten_2d(F.array("word"), F.array("w2")))
    return flat.select("vec_id", F.size("flat").alias("width"), bits.row_get("flat", 3).alias("bit3"), bits.row_get("flat", 70).alias("bit70"), bits.hamming("flat", bits.row_set("flat", 70, F.lit(True))).alias("cleared"))


def _codebook(kind):
    def query(spark, d):
        n = codes.KINDS[kind][0]
        book = codes.codebook(spark, kind)
        return book.select("byte", F.posexplode("code").alias("w", "word")).select("byte", "w", bits.display("word").alias("shown"), bits.count_ones("word").alias("ones")).where(F.col("w") < n // 64)

    return query


def encode_bytes(spark, d):
    single = sequence.unpack(sequence.distinct_windows(_table(spark, d, "documents"), 1), 1)
    return single.select(F.col("b0").alias("byte"), "n", F.concat_ws("", F.transform(codes.encode_byte("b0"), bits.display)).alias("code"))


def decode_noisy(spark, d):
    flips = F.array(*[F.lit(k) for k in (0, 1, 17, 40, 62)])
    noisy = spark.range(256).select(F.col("id").cast("int").alias("byte"), F.explode(flips).alias("k"))
    code = F.transform(codes.encode_byte("byte"), lambda w, p: w.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("k")) - 1))
    return codes.decode(noisy.withColumn("code", code)).select("byte", "k", "decoded", "distance")


def context_windows(spark, d):
    w = sequence.text_windows(_table(spark, d, "documents"), 3)
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("b0") + 3 * F.col("b1") + 7 * F.col("b2")).alias("s"), F.max("pos").alias("last"))


def _contexts(spark, d, width=3, by_context=False):
    return sequence.distinct_windows(_table(spark, d, "documents"), width, by_context=by_context)


def distinct_contexts(spark, d):
    return sequence.unpack(_contexts(spark, d), 3)


def distinct_five_grams(spark, d):
    w = _contexts(spark, d, 5)
    return w.groupBy(sequence.byte_of("code", 0, 5).alias("first")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max("n").alias("most"))


def block_transpose(spark, d):
    v = _sign_words(spark, d).select(F.col("vec_id").alias("row_id"), F.array("word").alias("words"))
    return transpose.block_transpose(v, 64).select("block", "column", bits.display("lane").alias("lane"))


def _numbers(spark, d, p=4):
    li = _table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", lanes.number(F.col("l_partkey"), p).alias("a"), lanes.number(F.col("l_suppkey"), p).alias("b"))


def bitslice_add(spark, d):
    n = _numbers(spark, d)
    made = n.withColumn("total", lanes.add("a", "b")).withColumn("wrapped", lanes.add_wrapping("a", "b", 4))
    made = made.withColumn("again", lanes.from_planes(lanes.extend(lanes.planes("total", 5), 8))).withColumn("seven", lanes.number(F.lit(23), 4))
    return made.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("total").alias("total"), F.max("wrapped").alias("wrapped"), F.max("again").alias("again"), F.max("seven").alias("seven"))


def bitslice_compare(spark, d):
    n = _numbers(spark, d).withColumn("c", lanes.compare("a", "b"))
    f = lambda k: F.sum(F.when(F.col(f"c.{k}"), 1).otherwise(0)).cast("bigint").alias(k)
    return n.groupBy("a").agg(f("lt"), f("eq"), f("gt"), F.sum(F.when(lanes.equality("a", "b"), 1).otherwise(0)).cast("bigint").alias("same"))


def lane_logic(spark, d):
    v = _sign_words(spark, d).withColumn("a", F.array("word")).withColumn("b", lanes.splat(F.col("label") % 2 == 0))
    c = lanes.lane_count
    add, cmp = lanes.full_adder(F.col("a"), F.col("b"), lanes.ones(1)), lanes.half_comparator(F.col("a"), F.col("b"))
    return v.select(
        "vec_id", c(lanes.lane_xor("a", "b")).alias("x"), c(lanes.lane_and("a", "b")).alias("n"), c(lanes.lane_or("a", "b")).alias("r"), c(lanes.lane_not("a")).alias("inv"),
        c(add["sum"]).alias("s"), c(add["carry"]).alias("c"), c(cmp["lt"]).alias("lt"), c(cmp["eq"]).alias("eq"), c(cmp["gt"]).alias("gt"),
    )


# ---------------------------------------------------------------- counting and search


def unit_counts(spark, d):
    """Unit counts of every output, feature, sign and threshold at the default precision."""
    table = kernels.unit_table(_contexts(spark, d, by_context=True), kernels.window_reader([]), perf.test_model(), 2, 4)
    return kernels.count_rows(table, (512, 2, 2), ["i", "s", "t"])


def unit_counts_labels(spark, d):
    """Unit counts of signed embedding bits against one-hot labels, over whole lanes of 64 rows."""
    e = counts.whole_lanes(_table(spark, d, "embeddings"), 64, "vec_id")
    x = e.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("i", "v")).select("row", "i", F.when(F.col("v") > 0, 1).otherwise(0).alias("x"))
    y = e.select(F.col("vec_id").alias("row"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == F.col("label"), 1).otherwise(0))).alias("o", "y"))
    outputs = list(range(10))
    ones = spark.createDataFrame([(o, 1) for o in outputs], "o int, threshold int")
    return counts.unit_counts_of_bits(x, y, model.test_filters(spark, outputs, 64), ones, 2, 4)


def _searched(spark, d, p=4):
    rows, read, m = stored(_contexts(spark, d, by_context=True), "contexts"), kernels.window_reader([]), perf.test_model()
    return rows, read, m, *kernels.search_candidates(kernels.unit_table(rows, read, m, 2, p), m, 2, E)


def exp_candidates(spark, d):
    _, _, _, cand_i, cand_s = _searched(spark, d)
    rows = [(o, k, int(cand_i[o, k]), int(cand_s[o, k])) for o in range(len(cand_i)) for k in range(E)]
    return spark.createDataFrame(rows, "o int, slot int, i int, s int")


def exp_counts(spark, d):
    """Exp counts of every output, mask and threshold, at three precisions."""
    rows, read, m, cand_i, cand_s = _searched(spark, d)
    out = None
    for p in (3, 4, None):
        one = kernels.count_rows(kernels.exp_table(rows, read, m, cand_i, cand_s, 3, p), (1 << E, 3), ["mask", "t"]).withColumn("p", F.lit(p or 0))
        out = one if out is None else out.union(one)
    return out


def update_filters(spark, d):
    """All filters after one iteration: the winning mask's accuracy, the new threshold and the terms."""
    rows, read, m, cand_i, cand_s = _searched(spark, d)
    new, accuracy = kernels.search_update(kernels.exp_table(rows, read, m, cand_i, cand_s, 3, 4), m, cand_i, cand_s)
    made = [(o, int(accuracy[o]), int(new.threshold[o]), int(new.n_set[o]), sum(2 * i + int(w) for i, w in enumerate(new.weight[o]) if w >= 0)) for o in range(256)]
    return spark.createDataFrame(made, "o int, accuracy bigint, threshold int, n_set bigint, terms bigint")


def sparse_weights(spark, d):
    s = model.sparse_weights(model.test_filters(spark), spark.range(256).select(F.col("id").cast("int").alias("o"), F.lit(1).alias("threshold")))
    return s.select("o", F.concat_ws(",", F.transform("terms", lambda t: F.concat_ws(":", t["i"], t["s"]))).alias("terms"), F.concat_ws(",", "thresholds").alias("thresholds"))


def dense_weights(spark, d):
    w = model.dense_weights(model.test_filters(spark))
    show = lambda c: F.concat_ws("", F.transform(c, bits.display)).alias(c)
    return w.select("o", show("sign"), show("mask"))


def layer_apply(spark, d):
    """For every output the distinct byte pairs, and the windows, that set it."""
    pairs = _contexts(spark, d).groupBy(F.shiftright("code", 8).alias("code")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    return kernels.count_outputs(pairs, perf.test_model())


def stacked_rows(spark, d):
    """The second layer's rows of every benchmark text, made by the fixed filters: set bits, decoded byte sums and the shifted byte."""
    docs = _table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    rows = stack.next_layer(stack.paired(stack.byte_rows(docs)), perf.test_model())
    ones = F.aggregate(F.transform("x", bits.count_ones), F.lit(0), lambda a, b: a + b)
    return rows.select("doc_id", "pos", "byte", ones.alias("ones"), bits.row_get("x", 7).alias("bit7"), bits.row_get("x", 200).alias("bit200"))


def lane_transpose_32(spark, d):
    """Blocks of 32 rows by 32 columns turned."""
    v = _sign_words(spark, d).select(F.col("vec_id").alias("row_id"), F.array("word").alias("words"))
    return transpose.block_transpose(v, 32, block=32).select("block", "column", F.lpad(F.bin("lane"), 32, "0").alias("lane"))


def trits(spark, d):
    """Order keys with a trit set, a bit or-ed in, and bits read from either end."""
    k = F.col("o_orderkey")
    trit = bits.set_trit(F.array(k), F.array(F.lit(0).cast("bigint")), k % 64, k % 3 == 0)
    return _table(spark, d, "orders").select(
        "o_orderkey", bits.lsb_get(k, k % 20).alias("low"), bits.display(F.get(bits.lsb_or(F.array(k), k % 62, k % 2 == 0), F.lit(0))).alias("put"),
        bits.display(F.get(trit["sign"], F.lit(0))).alias("sign"), bits.display(F.get(trit["mask"], F.lit(0))).alias("mask"),
    )


def perf_round_trip(spark, d):
    """A performance record written as JSON and read back."""
    from bitspark.sources.bits import PERF, read_perf, write_perf
    from bitspark.sources.shared import fresh

    path = fresh(spark, "records")
    tests = [("bitslice-BitArray64x8_u4", 4096, 8192, 10 * k, 20 * k, 3, 33 * k, Decimal(2**64 - k), Decimal(k)) for k in range(1, 4)]
    write_perf(spark.createDataFrame([("m", "x86_64", 8, 8, 0.5, 0.25, tests)], PERF), path)
    return read_perf(spark, path).select("machine_type", "n_cores", "price", F.explode("tests").alias("t")).select("machine_type", "n_cores", "price", "t.algorithm", "t.unit_nanos", "t.total_nanos", F.col("t.unit_hash").cast("string").alias("unit_hash"))


def layer_accuracy(spark, d):
    read, m = kernels.window_reader([]), perf.test_model()
    got = kernels.score(_contexts(spark, d, by_context=True), read, m)
    return got.select("correct", F.col("rows").alias("total"), (F.col("correct") / F.col("rows")).alias("accuracy"), "bits")


def layer_sparsity(spark, d):
    return layer.sparsity(model.test_filters(spark))


def unit_counts_all(spark, d):
    """All 524,288 unit counts at every precision, summed up for each output, sign and threshold."""
    m, rows, out = perf.test_model(), stored(_contexts(spark, d, by_context=True), "contexts"), None
    for p in PRECISIONS:
        each = kernels.count_rows(kernels.unit_table(rows, kernels.window_reader([]), m, 2, p), (512, 2, 2), ["i", "s", "t"])
        one = each.groupBy("o", "s", "t").agg(F.sum("count").alias("total"), F.max("count").alias("most")).withColumn("p", F.lit(p or 0))
        out = one if out is None else out.union(one)
    return out


def train_layer(spark, d):
    return train.report_table(spark, train.train_stack(_table(spark, d, "documents"), layers=1)[1])


def train_stack(spark, d):
    return train.report_table(spark, train.train_stack(_table(spark, d, "conversations"), layers=5)[1])


def synthetic_bits(spark, d):
    from bitspark.sources.bits import synthetic_rows

    rows = synthetic_rows(spark, 4096)
    return rows.agg(F.count("*").alias("n"), F.avg(bits.hamming(F.slice("x", 1, 4), "y")).alias("mean_distance"))


def perf_points(spark, d):
    return perf.perf_points(perf.run_tests(spark, 13, (1, 4), (3, 4)))


# ---------------------------------------------------------------- streams, places, slices


def stream_contexts(spark, d):
    """Distinct trigrams of all documents as one stream, in order of their id: windows cross documents."""
    stream = sequence.table_stream(_table(spark, d, "documents"), ["doc_id"])
    return sequence.unpack(sequence.stream_windows(stream, 3), 3)


def wide_windows(spark, d):
    """Windows of ten bytes, by their first."""
    w = _contexts(spark, d, 10)
    return w.groupBy(sequence.byte_of("code", 0, 10).alias("first")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.col("n") * sequence.byte_of("code", 9, 10)).alias("last"))


def file_contexts(spark, d):
    """The texts written as raw files and read in splits as streams: trigrams without a line feed, which are those of the texts' lines."""
    from bitspark.sources.shared import fresh

    path = fresh(spark, "raw")
    _table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.option("lineSep", "\n").text(path)
    found = sequence.unpack(sequence.file_windows(spark, path, 3), 3)
    return found.where("b0 <> 10 and b1 <> 10 and b2 <> 10")


def positional_zip(spark, d):
    """The k-th dearest order beside the k-th line item."""
    orders, lines = _table(spark, d, "orders").select("o_orderkey", "o_totalprice"), _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    both = positional.zipped(orders, [F.col("o_totalprice").desc(), "o_orderkey"], lines, ["l_orderkey", "l_linenumber"])
    return both.select("number", "left.o_orderkey", "right.l_orderkey", "right.l_linenumber")


def chunked_rows(spark, d):
    """Whole chunks of 64 events in order of their id, with what each sums up to."""
    runs = positional.chunks(_table(spark, d, "events").select("event_id", "user_id"), ["event_id"], 64, rest=False)
    return runs.groupBy("chunk").agg(F.count("*").alias("n"), F.min("row.event_id").alias("first"), F.max("row.event_id").alias("last"), F.sum("row.user_id").alias("users"), F.sum(F.col("row.user_id") * F.col("place")).alias("placed"))


def _labelled_rows(spark, d):
    """Whole lanes of rows that don't collapse: signed embedding bits, and one-hot labels at the front of a word."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (63 - F.col("label")).cast("int"))
    rows = counts.whole_lanes(_sign_words(spark, d), 64, "vec_id").select(F.array("word").alias("x"), F.array(one).alias("y"))
    outputs = list(range(10))
    return rows, model.Model.from_tables(model.test_filters(spark, outputs, 64), spark.createDataFrame([(o, 1) for o in outputs], "o int, threshold int"), 64, 10)


def unit_counts_lanes(spark, d):
    """Unit counts of signed embedding bits against one-hot labels, on slices."""
    rows, m = _labelled_rows(spark, d)
    return kernels.count_rows(kernels.unit_table(rows, kernels.lane_reader(), m, 2, 4), (64, 2, 2), ["i", "s", "t"])


def exp_counts_lanes(spark, d):
    """Exp counts of the best candidates of the same, on slices, with sums of three bits that wrap around."""
    rows, m = _labelled_rows(spark, d)
    cand_i, cand_s = kernels.search_candidates(kernels.unit_table(rows, kernels.lane_reader(), m, 2, 4), m, 2, E)
    return kernels.count_rows(kernels.exp_table(rows, kernels.lane_reader(), m, cand_i, cand_s, 3, 3), (1 << E, 3), ["mask", "t"])


def train_benchmark(spark, d):
    """A layer's filters after four iterations on the benchmark texts: every weight, with its output's threshold and accuracy."""
    rows = stored(train.by_context(sequence.distinct_windows(_table(spark, d, "benchmark"), 3), 3), "windows")
    m, history = train.fit_layer(rows, kernels.window_reader([]), iterations=4)
    weights, thresholds = m.to_tables(spark)
    right = spark.createDataFrame([(o, int(n)) for o, n in enumerate(history[-1])], "o int, accuracy bigint")
    return thresholds.join(right, "o").join(weights, "o", "left").select("o", "threshold", "accuracy", F.coalesce("i", F.lit(-1)).alias("i"), F.coalesce("s", F.lit(-1)).alias("s"))


def compare_planes(spark, d):
    """Two-bit numbers compared plane by plane: a vector's bits with the next one's, and below them whether their labels are even."""
    v = _sign_words(spark, d)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("word").alias("w2"), F.col("label").alias("l2"))
    below = lanes.half_comparator(lanes.splat(F.col("label") % 2 == 0), lanes.splat(F.col("l2") % 2 == 0))
    both = v.join(nxt, "vec_id").withColumn("c", lanes.full_comparator(F.array("word"), F.array("w2"), below))
    return both.select("vec_id", *[lanes.lane_count(F.col(f"c.{k}")).alias(k) for k in ("lt", "eq", "gt")])


def set_rows(spark, d):
    """Rows of zeros with one bit of every customer's key set, shown and read."""
    row = bits.row_set(F.array_repeat(F.lit(bits.ZERO).cast("bigint"), 4), F.col("at"), F.lit(True))
    made = _table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 256).alias("at")).withColumn("row", row)
    return made.select("c_custkey", F.concat_ws("", F.transform("row", bits.display)).alias("shown"), bits.row_get("row", "at").alias("there"), bits.row_get("row", (F.col("at") + 1) % 256).alias("beside"), bits.hamming("row", F.array_repeat(F.lit(bits.ZERO).cast("bigint"), 4)).alias("ones"))


# ---------------------------------------------------------------- codes, filters and records of given rows


def coded_keys(spark, d):
    """The codewords of all kinds of every customer's key modulo 256, and the distances to the codes of its nation."""
    byte, nation = (F.col("c_custkey") % 256).cast("int"), F.col("c_nationkey")
    out = _table(spark, d, "customer").select("c_custkey", byte.alias("byte"), nation.alias("nation"))
    for kind in codes.KINDS:
        a, b = codes.encode_byte(F.col("byte"), kind), codes.encode_byte(F.col("nation"), kind)
        out = out.withColumn(f"{kind}_ones", F.aggregate(F.transform(a, bits.count_ones), F.lit(0), lambda x, y: x + y)).withColumn(f"{kind}_distance", bits.hamming(a, b)).withColumn(f"{kind}_bit", codes.code_bit(F.col("byte"), F.col("nation"), kind))
    return out.drop("byte", "nation")


def decoded_keys(spark, d):
    """The nearest codeword of every supplier's key modulo 256 with some bits of its first word turned, as many as its nation's key."""
    s = _table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 256).cast("int").alias("byte"), F.col("s_nationkey").alias("k"))
    noise = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("k") + 37).cast("int")) - 1
    code = F.transform(codes.encode_byte("byte"), lambda w, p: F.when(p == 0, w.bitwiseXOR(noise)).otherwise(w))
    return codes.decode(s.withColumn("code", code)).select("s_suppkey", "decoded", "distance")


def _sold(spark, d):
    """Filters made of line items: output by supplier, input by part; a feature is negated if most of its lines have odd numbers."""
    li = _table(spark, d, "lineitem").select((F.col("l_suppkey") % 16).cast("int").alias("o"), (F.col("l_partkey") * 7 % 128).cast("int").alias("i"), (F.col("l_linenumber") % 2).alias("odd"), "l_quantity")
    weights = li.groupBy("o", "i").agg((2 * F.sum("odd") > F.count("*")).cast("int").alias("s"), F.sum("l_quantity").alias("q")).where("q % 3 = 0")
    thresholds = li.groupBy("o").agg((F.max("i") % 5).cast("int").alias("threshold"))
    return weights.select("o", "i", "s"), thresholds


def sold_filters(spark, d):
    """Sparse and dense forms of such filters."""
    weights, thresholds = _sold(spark, d)
    sparse = model.sparse_weights(weights, thresholds, 3).select("o", F.concat_ws(",", F.transform("terms", lambda t: F.concat_ws(":", t["i"], t["s"]))).alias("terms"), F.concat_ws(",", "thresholds").alias("thresholds"))
    show = lambda c: F.concat_ws("", F.transform(c, bits.display)).alias(c)
    return sparse.join(model.dense_weights(weights, 128).select("o", show("sign"), show("mask")), "o", "left")


def sold_sparsity(spark, d):
    weights, _ = _sold(spark, d)
    return layer.sparsity(weights, 128, 16)


def sold_records(spark, d):
    """Performance records made of orders, written as JSON, read back, and the points of their plot."""
    from bitspark.sources.bits import PERF, read_perf, write_perf
    from bitspark.sources.shared import fresh

    o = _table(spark, d, "orders").select((F.col("o_orderkey") % 9).alias("lane"), (F.col("o_custkey") % 7).alias("bits"), "o_orderkey", "o_custkey")
    tests = o.groupBy("lane", "bits").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("u"), F.sum("o_custkey").alias("e"))
    name = F.concat(F.lit("bitslice-BitArray64x"), "lane", F.lit("_u"), "bits")
    big = lambda c: (F.lit(str(2**64)).cast("decimal(20,0)") - F.col(c)).cast("decimal(20,0)")
    test = F.struct(name.alias("algorithm"), F.lit(4096).cast("bigint").alias("chunk_size"), F.col("n").alias("n_examples"), F.col("u").alias("unit_nanos"), F.col("e").alias("exp_nanos"), F.col("n").alias("apply_nanos"), (F.col("u") + F.col("e")).alias("total_nanos"), big("u").alias("unit_hash"), big("e").alias("exp_hash"))
    records = tests.groupBy("lane").agg(F.collect_list(test).alias("tests")).select(F.concat(F.lit("m"), "lane").alias("machine_type"), F.lit("x").alias("cpu_arch"), F.lit(8).alias("n_cores"), F.lit(8).alias("n_physical"), F.lit(0.5).alias("price"), F.lit(0.25).alias("spot_price"), "tests")
    path = fresh(spark, "records")
    write_perf(records.select(*PERF.fieldNames()), path)
    back = read_perf(spark, path)
    points = perf.perf_points(back).select("precision", "x", "y")
    hashes = back.select(F.explode("tests").alias("t")).select(F.regexp_extract("t.algorithm", r"_u(\d+)$", 1).cast("int").alias("precision"), F.regexp_extract("t.algorithm", r"x(\d+)_", 1).cast("int").alias("x"), F.col("t.unit_hash").cast("string").alias("unit_hash"), F.col("t.exp_hash").cast("string").alias("exp_hash"))
    return points.join(hashes, ["precision", "x"])


# ---------------------------------------------------------------- SQL

_BYTES = """
l AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS h FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, unnest(h) AS h, generate_subscripts(h, 1) - 1 AS pos FROM l),
bytes AS (SELECT doc_id, pos, CAST('0x' || h AS INTEGER) AS byte FROM b),
w AS (SELECT doc_id, pos, byte AS b0, lead(byte, 1) OVER o AS b1, lead(byte, 2) OVER o AS b2, lead(byte, 3) OVER o AS b3, lead(byte, 4) OVER o AS b4 FROM bytes WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
ctx AS (SELECT b0, b1, b2, count(*) AS n FROM w WHERE b2 IS NOT NULL GROUP BY ALL)"""

_SIGNS = "signs AS (SELECT vec_id, label, list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings)"


def _code(byte: str, i: str, offset: int = 0) -> str:
    return f"(bit_count({byte} & (({i}) // 64 * 64 + 63 - ({i}) % 64 + {offset})) % 2)"


def _filters(outputs: str, inputs: int = 512) -> str:
    steps = ", ".join(f"({k}, {m}, {int(e)})" for k, (m, e) in enumerate(model.STEPS))
    return f"""
steps AS (SELECT * FROM (VALUES {steps}) AS s(k, m, e)),
weights AS (
  SELECT o, i, arg_max(s, k) AS s FROM (SELECT o, (o * m) % {inputs} AS i, k, CASE WHEN o % 2 = 0 THEN e ELSE 1 - e END AS s FROM ({outputs}) AS x(o), steps) GROUP BY o, i)"""


_ALL = "SELECT range::INTEGER FROM range(256)"
_FEATURE = f"CASE WHEN f.i < 256 THEN {_code('c.b0', 'f.i % 256')} ELSE {_code('c.b1', 'f.i % 256')} END"


def _base(outputs: str = _ALL) -> str:
    """Contexts by output with the exact sum of the filter and the target bit."""
    return f"""{_BYTES}, {_filters(outputs)},
base AS MATERIALIZED (
  SELECT f.o, c.b0, c.b1, c.b2, c.n, sum(xor({_FEATURE}, f.s))::BIGINT AS c, any_value({_code('c.b2', 'f.o')}) AS y
  FROM ctx c, weights f GROUP BY f.o, c.b0, c.b1, c.b2, c.n)"""


def _wrap(v: str, p) -> str:
    return v if p is None else f"(({v}) & {(1 << p) - 1})"


def _unit(p) -> str:
    """SELECT of unit counts from ``cells(o, i, c, y, x, n)``."""
    v = _wrap("c + xor(x, s)", p)
    return f"""
SELECT k.o, k.i, k.s, k.t, {p or 0} AS p, CASE WHEN w.i IS NOT NULL THEN 0 ELSE k.count END AS count FROM (
  SELECT o, i, s, t, CAST(sum(CASE WHEN CAST({v} > {_wrap('1 + t', p)} AS INTEGER) = y THEN n ELSE 0 END) AS BIGINT) AS count
  FROM cells, (VALUES (0), (1)) AS a(s), (VALUES (0), (1)) AS b(t) GROUP BY o, i, s, t) k LEFT JOIN weights w ON w.o = k.o AND w.i = k.i"""


#: A feature depends on one byte, so that each half of the features needs the counts of its own byte only.
_CELLS = f"""
half AS (SELECT 0 AS h, o, c, y, b0 AS b, sum(n) AS n FROM base GROUP BY ALL UNION ALL SELECT 1, o, c, y, b1, sum(n) FROM base GROUP BY ALL),
cells AS MATERIALIZED (SELECT o, h * 256 + j AS i, c, y, {_code('b', 'j')} AS x, sum(n) AS n FROM half, (SELECT range AS j FROM range(256)) GROUP BY ALL)"""

_CANDIDATES = f"""{_base()}, {_CELLS}, unit AS ({_unit(4)}),
best AS (
  SELECT o, i, max(struct_pack(count := count, s := s)) AS x FROM unit u WHERE NOT EXISTS (SELECT 1 FROM weights w WHERE w.o = u.o AND w.i = u.i) GROUP BY o, i),
cand AS MATERIALIZED (
  SELECT o, CAST(slot AS INTEGER) AS slot, i, s FROM (SELECT o, i, x.s AS s, row_number() OVER (PARTITION BY o ORDER BY x.count DESC, i) - 1 AS slot FROM best) WHERE slot < {E})"""

_EXP = f"""{_CANDIDATES},
pat AS (SELECT c.o, c.b0, c.b1, c.b2, sum(xor({_FEATURE}, f.s) << f.slot)::BIGINT AS pattern FROM base c JOIN cand f ON f.o = c.o GROUP BY ALL),
cells2 AS MATERIALIZED (SELECT b.o, b.c, p.pattern, b.y, sum(b.n) AS n FROM base b JOIN pat p USING (o, b0, b1, b2) GROUP BY ALL)"""


def _exp_sql(p) -> str:
    v = _wrap("c + bit_count(pattern & mask)", p)
    return f"""
SELECT o, mask, t, {p or 0} AS p, CAST(sum(CASE WHEN CAST({v} > {_wrap('1 + t', p)} AS INTEGER) = y THEN n ELSE 0 END) AS BIGINT) AS count
FROM cells2, (SELECT range AS mask FROM range({1 << E})) m, (VALUES (0), (1), (2)) AS b(t) GROUP BY o, mask, t"""


def _train_sql(iterations: int, p: int = 4) -> str:
    """CTEs of ``iterations`` of training on ``ctx``, from empty filters: ``w{k}(o, i, s)``, ``h{k}(o, threshold, accuracy)``."""
    out = "w0 AS (SELECT 0 AS o, 0 AS i, 0 AS s WHERE false), h0 AS (SELECT range::INTEGER AS o, 0 AS threshold, 0::BIGINT AS accuracy FROM range(256))"
    for k in range(iterations):
        feature = _FEATURE
        out += f""",
base{k} AS MATERIALIZED (
  SELECT h.o, c.b0, c.b1, c.b2, c.n, coalesce(sum(CASE WHEN f.i IS NOT NULL THEN xor({feature}, f.s) END), 0)::BIGINT AS c, any_value({_code('c.b2', 'h.o')}) AS y
  FROM ctx c CROSS JOIN h{k} h LEFT JOIN w{k} f ON f.o = h.o GROUP BY h.o, c.b0, c.b1, c.b2, c.n),
half{k} AS (SELECT 0 AS h, o, c, y, b0 AS b, sum(n) AS n FROM base{k} GROUP BY ALL UNION ALL SELECT 1, o, c, y, b1, sum(n) FROM base{k} GROUP BY ALL),
cells{k} AS MATERIALIZED (SELECT o, h * 256 + j AS i, c, y, {_code('b', 'j')} AS x, sum(n) AS n FROM half{k}, (SELECT range AS j FROM range(256)) GROUP BY ALL),
unit{k} AS (
  SELECT z.o, z.i, s, t, CAST(sum(CASE WHEN CAST({_wrap('c + xor(x, s)', p)} > {_wrap('threshold + t', p)} AS INTEGER) = y THEN n ELSE 0 END) AS BIGINT) AS count
  FROM cells{k} z JOIN h{k} h ON h.o = z.o, (VALUES (0), (1)) AS a(s), (VALUES (0), (1)) AS b(t) GROUP BY z.o, z.i, s, t),
best{k} AS (SELECT o, i, max(struct_pack(count := count, s := s)) AS x FROM unit{k} u WHERE NOT EXISTS (SELECT 1 FROM w{k} w WHERE w.o = u.o AND w.i = u.i) GROUP BY o, i),
cand{k} AS MATERIALIZED (
  SELECT o, CAST(slot AS INTEGER) AS slot, i, s FROM (SELECT o, i, x.s AS s, row_number() OVER (PARTITION BY o ORDER BY x.count DESC, i) - 1 AS slot FROM best{k}) WHERE slot < {E}),
pat{k} AS (SELECT c.o, c.b0, c.b1, c.b2, sum(xor({feature}, f.s) << f.slot)::BIGINT AS pattern FROM base{k} c JOIN cand{k} f ON f.o = c.o GROUP BY ALL),
tab{k} AS MATERIALIZED (SELECT b.o, b.c, p.pattern, b.y, sum(b.n) AS n FROM base{k} b JOIN pat{k} p USING (o, b0, b1, b2) GROUP BY ALL),
exp{k} AS (
  SELECT z.o, mask, t, CAST(sum(CASE WHEN CAST({_wrap('c + bit_count(pattern & mask)', p)} > {_wrap('threshold + t', p)} AS INTEGER) = y THEN n ELSE 0 END) AS BIGINT) AS count
  FROM tab{k} z JOIN h{k} h ON h.o = z.o, (SELECT range AS mask FROM range({1 << E})) m, (VALUES (0), (1), (2)) AS b(t) GROUP BY z.o, mask, t),
m{k} AS (SELECT o, mask, max(struct_pack(count := count, low := -t)) AS z FROM exp{k} GROUP BY o, mask),
ns{k} AS (SELECT h.o, count(w.i) AS n_set FROM h{k} h LEFT JOIN w{k} w ON w.o = h.o GROUP BY h.o),
win{k} AS MATERIALIZED (SELECT o, max(struct_pack(count := z.count, few := -bit_count(mask), mask := mask, low := z.low)) AS z FROM m{k} JOIN ns{k} USING (o) WHERE bit_count(mask) + n_set < 16 GROUP BY o),
w{k + 1} AS MATERIALIZED (SELECT o, i, s FROM w{k} UNION ALL SELECT c.o, c.i, c.s FROM cand{k} c JOIN win{k} USING (o) WHERE (win{k}.z.mask >> c.slot) & 1 = 1),
h{k + 1} AS MATERIALIZED (SELECT h.o, CAST(h.threshold - v.z.low AS INTEGER) AS threshold, v.z.count AS accuracy FROM h{k} h JOIN win{k} v ON v.o = h.o)"""
    return out


def _codebook_sql(kind: str) -> str:
    n, offset = codes.KINDS[kind]
    return f"""
SELECT byte, CAST(i // 64 AS INTEGER) AS w, string_agg(CAST(x AS VARCHAR), '' ORDER BY i) AS shown, CAST(sum(x) AS INTEGER) AS ones
FROM (SELECT a.range::INTEGER AS byte, b.range AS i, {_code('a.range', 'b.range', offset)} AS x FROM range(256) a, range({n}) b) GROUP BY byte, i // 64"""


def _sql() -> dict[str, str]:
    bit = "(o_orderkey // (1::BIGINT << {s})) % 2"
    at = "(o_orderkey % 64)"
    cleared = f"""CASE WHEN 63 - {at} <= 62 THEN (o_orderkey | (1::BIGINT << 58)) & ~(1::BIGINT << CAST(least(62, 63 - {at}) AS INTEGER)) ELSE (o_orderkey | (1::BIGINT << 58)) END"""
    shown = f"lpad(bin({cleared}), 64, '0')"
    cat = "list_concat(a.bits, b.bits)"
    lane = "CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END"
    s = lambda e: f"CAST(list_sum(list_transform(bits, lambda x: {e})) AS INTEGER)"
    labelled = f"""every AS (SELECT * FROM embeddings), whole AS (SELECT * FROM every WHERE vec_id < (SELECT count(*) // 64 * 64 FROM every)),
          {_SIGNS.replace('FROM embeddings', 'FROM whole')}, {_filters('SELECT range::INTEGER FROM range(10)', 64)},
          base AS MATERIALIZED (SELECT vec_id, o, sum(xor(bits[i + 1], s))::BIGINT AS c, any_value(CASE WHEN label = o THEN 1 ELSE 0 END) AS y FROM signs, weights GROUP BY vec_id, o),
          cells AS (SELECT o, i, c, y, bits[i + 1] AS x, count(*) AS n FROM base JOIN signs USING (vec_id), (SELECT range AS i FROM range(64)) GROUP BY ALL)"""
    sold = """li AS (SELECT CAST(l_suppkey % 16 AS INTEGER) AS o, CAST(l_partkey * 7 % 128 AS INTEGER) AS i, l_linenumber % 2 AS odd, l_quantity FROM lineitem),
          weights AS (SELECT o, i, CASE WHEN 2 * sum(odd) > count(*) THEN 1 ELSE 0 END AS s FROM li GROUP BY o, i HAVING sum(l_quantity) % 3 = 0),
          thresholds AS (SELECT o, CAST(max(i) % 5 AS INTEGER) AS threshold FROM li GROUP BY o)"""
    update = f"""WITH {_EXP}, x AS ({_exp_sql(4)}), ns AS (SELECT o, count(*) AS n_set FROM weights GROUP BY o),
          m AS (SELECT o, mask, max(struct_pack(count := count, low := -(1 + t))) AS z FROM x GROUP BY o, mask),
          win AS (SELECT o, max(struct_pack(count := z.count, few := -bit_count(mask), mask := mask, low := z.low)) AS z FROM m JOIN ns USING (o) WHERE bit_count(mask) + n_set < 16 GROUP BY o),
          new AS (SELECT o, i, s FROM weights UNION ALL SELECT c.o, c.i, c.s FROM cand c JOIN win USING (o) WHERE (win.z.mask >> c.slot) & 1 = 1)
          SELECT o, win.z.count AS accuracy, CAST(-win.z.low AS INTEGER) AS threshold, n_set, terms
          FROM win JOIN (SELECT o, count(*) AS n_set, CAST(sum(i * 2 + s) AS BIGINT) AS terms FROM new GROUP BY o) USING (o)"""
    return {
        "word_bits": f"""SELECT o_orderkey, CAST(bit_count(o_orderkey) AS INTEGER) AS ones, {bit.format(s=3)} = 1 AS bit60,
          CASE WHEN 63 - {at} > 62 THEN 0 ELSE CAST((o_orderkey >> CAST(least(62, 63 - {at}) AS INTEGER)) & 1 AS INTEGER) END AS bit_at,
          CAST(bit_count({cleared}) AS INTEGER) AS ones_set, {shown} AS shown, xor(o_orderkey, 21::BIGINT) AS x, o_orderkey & 21 AS a, o_orderkey | 21 AS r, CAST(64 - bit_count(o_orderkey) AS INTEGER) AS ones_not FROM orders""",
        "word_hamming": f"""WITH {_SIGNS} SELECT a.vec_id, CAST(list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance, CAST(list_sum(a.bits) AS INTEGER) AS ones
          FROM signs a JOIN signs b ON b.vec_id = a.vec_id + 1""",
        "masked_hamming": f"""WITH {_SIGNS}, {_filters('SELECT range::INTEGER FROM range(1, 17)', 64)}
          SELECT vec_id, o, CAST(sum(xor(bits[i + 1], s)) AS INTEGER) AS distance FROM signs, weights GROUP BY vec_id, o""",
        "flatten_pairs": f"""WITH {_SIGNS} SELECT a.vec_id, 2 AS width, {cat}[4] = 1 AS bit3, {cat}[71] = 1 AS bit70, 1 - {cat}[71] AS cleared FROM signs a JOIN signs b ON b.vec_id = a.vec_id + 1""",
        "codebook_256": _codebook_sql("full"), "codebook_thin": _codebook_sql("thin"), "codebook_wide": _codebook_sql("wide"),
        "encode_bytes": f"""WITH {_BYTES}, k AS (SELECT byte, count(*) AS n FROM bytes GROUP BY byte)
          SELECT byte, n, string_agg(CAST({_code('byte', 'i')} AS VARCHAR), '' ORDER BY i) AS code FROM k, (SELECT range AS i FROM range(256)) GROUP BY byte, n""",
        "decode_noisy": f"""WITH f AS (SELECT a.range::INTEGER AS byte, k FROM range(256) a, (VALUES (0), (1), (17), (40), (62)) AS v(k)),
          c AS (SELECT f.byte, k, d.range::INTEGER AS decoded, sum(CASE WHEN xor({_code('f.byte', 'i')}, CASE WHEN 63 - i % 64 < k THEN 1 ELSE 0 END) <> {_code('d.range', 'i')} THEN 1 ELSE 0 END)::INTEGER AS distance
            FROM f, range(256) d, (SELECT range AS i FROM range(256)) GROUP BY ALL)
          SELECT byte, k, decoded, distance FROM (SELECT *, row_number() OVER (PARTITION BY byte, k ORDER BY distance, decoded) AS r FROM c) WHERE r = 1""",
        "context_windows": f"WITH {_BYTES} SELECT doc_id, count(*) AS n, CAST(sum(b0 + 3 * b1 + 7 * b2) AS BIGINT) AS s, CAST(max(pos) AS INTEGER) AS last FROM w WHERE b2 IS NOT NULL GROUP BY doc_id",
        "distinct_contexts": f"WITH {_BYTES} SELECT * FROM ctx",
        "distinct_five_grams": f"""WITH {_BYTES}, g AS (SELECT b0, b1, b2, b3, b4, count(*) AS n FROM w WHERE b4 IS NOT NULL GROUP BY ALL)
          SELECT b0 AS first, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS n, max(n) AS most FROM g GROUP BY b0""",
        "block_transpose": f"""WITH {_SIGNS}, r AS (SELECT vec_id // 64 AS block, vec_id % 64 AS r, unnest(bits) AS bit, generate_subscripts(bits, 1) - 1 AS col FROM signs)
          SELECT block, CAST(col AS INTEGER) AS "column", string_agg(CAST(bit AS VARCHAR), '' ORDER BY r) AS lane FROM r GROUP BY block, col HAVING count(*) = 64""",
        "bitslice_add": """SELECT l_partkey % 16 AS a, l_suppkey % 16 AS b, count(*) AS n, l_partkey % 16 + l_suppkey % 16 AS total, (l_partkey % 16 + l_suppkey % 16) % 16 AS wrapped,
          l_partkey % 16 + l_suppkey % 16 AS again, 7::BIGINT AS seven FROM lineitem GROUP BY ALL""",
        "bitslice_compare": """SELECT a, CAST(sum((a < b)::INTEGER) AS BIGINT) AS lt, CAST(sum((a = b)::INTEGER) AS BIGINT) AS eq, CAST(sum((a > b)::INTEGER) AS BIGINT) AS gt, CAST(sum((a = b)::INTEGER) AS BIGINT) AS same
          FROM (SELECT l_partkey % 16 AS a, l_suppkey % 16 AS b FROM lineitem) GROUP BY a""",
        "lane_logic": f"""WITH {_SIGNS}, v AS (SELECT vec_id, bits, {lane} AS b FROM signs)
          SELECT vec_id, {s('xor(x, b)')} AS x, {s('x & b')} AS n, {s('x | b')} AS r, {s('1 - x')} AS inv, {s('xor(xor(x, b), 1)')} AS s, {s('(x & b) | (xor(x, b) & 1)')} AS c,
          {s('(1 - x) & b')} AS lt, {s('1 - xor(x, b)')} AS eq, {s('x & (1 - b)')} AS gt FROM v""",
        "unit_counts": f"WITH {_base()}, {_CELLS} SELECT o, CAST(i AS INTEGER) AS i, s, t, count FROM ({_unit(4)})",
        "unit_counts_labels": f"WITH {labelled} SELECT o, CAST(i AS INTEGER) AS i, s, t, count FROM ({_unit(4)})",
        "exp_candidates": f"WITH {_CANDIDATES} SELECT o, slot, CAST(i AS INTEGER) AS i, s FROM cand",
        "exp_counts": f"WITH {_EXP} " + " UNION ALL ".join(_exp_sql(p) for p in (3, 4, None)),
        "update_filters": update,
        "sparse_weights": f"WITH {_filters(_ALL)} SELECT o, string_agg(i || ':' || s, ',' ORDER BY i) AS terms, '1,2' AS thresholds FROM weights GROUP BY o",
        "dense_weights": f"""WITH {_filters(_ALL)} SELECT q.range::INTEGER AS o, string_agg(CASE WHEN w.s = 1 THEN '1' ELSE '0' END, '' ORDER BY p.range) AS sign, string_agg(CASE WHEN w.i IS NULL THEN '0' ELSE '1' END, '' ORDER BY p.range) AS mask
          FROM range(256) q CROSS JOIN range(512) p LEFT JOIN weights w ON w.o = q.range AND w.i = p.range GROUP BY q.range""",
        "layer_apply": f"WITH {_base(_ALL)} SELECT o AS bit, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS n FROM base WHERE c > 1 GROUP BY o",
        "layer_accuracy": f"""WITH {_base(_ALL)},
          book AS (SELECT a.range::INTEGER AS byte, b.range::INTEGER AS o, {_code('a.range', 'b.range')} AS bit FROM range(256) a, range(256) b),
          kinds AS (SELECT b0, b1, list(CASE WHEN c > 1 THEN 1 ELSE 0 END ORDER BY o) AS bits FROM (SELECT DISTINCT o, b0, b1, c FROM base) GROUP BY b0, b1),
          codes AS (SELECT byte, list(bit ORDER BY o) AS bits FROM book GROUP BY byte),
          near AS (SELECT k.b0, k.b1, c.byte, list_inner_product(list_transform(k.bits, lambda x: (2 * x - 1)::DOUBLE), list_transform(c.bits, lambda x: (2 * x - 1)::DOUBLE)) AS alike FROM kinds k, codes c),
          decoded AS (SELECT b0, b1, byte FROM (SELECT *, row_number() OVER (PARTITION BY b0, b1 ORDER BY alike DESC, byte) AS r FROM near) WHERE r = 1),
          bitsum AS (SELECT CAST(sum(CASE WHEN CAST(c > 1 AS INTEGER) = y THEN n ELSE 0 END) AS BIGINT) AS bits FROM base)
          SELECT CAST(sum(CASE WHEN byte = b2 THEN n ELSE 0 END) AS BIGINT) AS correct, CAST(sum(n) AS BIGINT) AS total,
            CAST(sum(CASE WHEN byte = b2 THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS accuracy, any_value(bits) AS bits FROM ctx JOIN decoded USING (b0, b1), bitsum""",
        "layer_sparsity": f"WITH {_filters(_ALL)} SELECT count(*) AS n_set, 1::DOUBLE - count(*)::DOUBLE / 131072::DOUBLE AS sparsity FROM weights",
        "unit_counts_all": f"WITH {_base()}, {_CELLS}, u AS (" + " UNION ALL ".join(_unit(p) for p in PRECISIONS) + ") SELECT o, s, t, p, CAST(sum(count) AS BIGINT) AS total, max(count) AS most FROM u GROUP BY o, s, t, p",
        "stacked_rows": f"""WITH {_BYTES.replace('doc_id', 'item_id').replace('FROM documents', 'FROM benchmark')}, {_filters(_ALL)},
          r AS (SELECT item_id AS doc_id, CAST(pos AS INTEGER) AS pos, b0, b1, b2 AS byte FROM w WHERE b2 IS NOT NULL),
          s AS (SELECT c.doc_id, c.pos, c.byte, f.o, sum(xor({_FEATURE}, f.s)) AS c FROM r c, weights f GROUP BY ALL)
          SELECT doc_id, pos, byte, CAST(sum(CASE WHEN c > 1 THEN 1 ELSE 0 END) AS INTEGER) AS ones, coalesce(bool_or(c > 1) FILTER (o = 7), false) AS bit7, coalesce(bool_or(c > 1) FILTER (o = 200), false) AS bit200 FROM s GROUP BY doc_id, pos, byte""",
        "lane_transpose_32": f"""WITH {_SIGNS}, r AS (SELECT vec_id // 32 AS block, vec_id % 32 AS r, unnest(bits[1:32]) AS bit, generate_subscripts(bits[1:32], 1) - 1 AS col FROM signs)
          SELECT block, CAST(col AS INTEGER) AS "column", string_agg(CAST(bit AS VARCHAR), '' ORDER BY r) AS lane FROM r GROUP BY block, col HAVING count(*) = 32""",
        "trits": f"""SELECT o_orderkey, (o_orderkey >> CAST(o_orderkey % 20 AS INTEGER)) & 1 = 1 AS low,
          lpad(bin(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey | (1::BIGINT << CAST(o_orderkey % 62 AS INTEGER)) ELSE o_orderkey END), 64, '0') AS put,
          CASE WHEN o_orderkey % 3 = 0 THEN substr(b, 1, CAST({at} AS INTEGER)) || '1' || substr(b, CAST({at} AS INTEGER) + 2) ELSE substr(b, 1, CAST({at} AS INTEGER)) || '0' || substr(b, CAST({at} AS INTEGER) + 2) END AS sign,
          repeat('0', CAST({at} AS INTEGER)) || '1' || repeat('0', CAST(63 - {at} AS INTEGER)) AS mask FROM (SELECT o_orderkey, lpad(bin(o_orderkey), 64, '0') AS b FROM orders)""",
        "stream_contexts": """WITH whole AS (SELECT regexp_extract_all(hex(encode(string_agg(text, '' ORDER BY doc_id))), '..') AS h FROM documents), b AS (SELECT unnest(h) AS h, generate_subscripts(h, 1) AS pos FROM whole),
          w AS (SELECT CAST('0x' || h AS INTEGER) AS b0, CAST('0x' || lead(h, 1) OVER (ORDER BY pos) AS INTEGER) AS b1, CAST('0x' || lead(h, 2) OVER (ORDER BY pos) AS INTEGER) AS b2 FROM b)
          SELECT b0, b1, b2, count(*) AS n FROM w WHERE b2 IS NOT NULL GROUP BY ALL""",
        "file_contexts": f"WITH {_BYTES} SELECT * FROM ctx WHERE b0 <> 10 AND b1 <> 10 AND b2 <> 10",
        "wide_windows": """WITH l AS (SELECT hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL), p AS (SELECT h, unnest(generate_series(1, len(h) // 2 - 9)) AS k FROM l WHERE len(h) >= 20),
          g AS (SELECT substr(h, 2 * k - 1, 20) AS code, count(*) AS n FROM p GROUP BY ALL)
          SELECT CAST('0x' || substr(code, 1, 2) AS INTEGER) AS first, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS n, max(n) AS most, CAST(sum(n * CAST('0x' || substr(code, 19, 2) AS INTEGER)) AS BIGINT) AS last FROM g GROUP BY 1""",
        "positional_zip": """SELECT number, o_orderkey, l_orderkey, l_linenumber FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS number FROM orders)
          JOIN (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS number FROM lineitem) USING (number)""",
        "chunked_rows": """SELECT k // 64 AS chunk, count(*) AS n, min(event_id) AS first, max(event_id) AS last, CAST(sum(user_id) AS BIGINT) AS users, CAST(sum(user_id * (k % 64)) AS BIGINT) AS placed
          FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events) WHERE k < (SELECT count(*) // 64 * 64 FROM events) GROUP BY 1""",
        "unit_counts_lanes": f"WITH {labelled} SELECT o, CAST(i AS INTEGER) AS i, s, t, count FROM ({_unit(4)})",
        "exp_counts_lanes": f"""WITH {labelled}, unit AS ({_unit(4)}),
          best AS (SELECT o, i, max(struct_pack(count := count, s := s)) AS x FROM unit u WHERE NOT EXISTS (SELECT 1 FROM weights w WHERE w.o = u.o AND w.i = u.i) GROUP BY o, i),
          cand AS MATERIALIZED (SELECT o, CAST(slot AS INTEGER) AS slot, i, s FROM (SELECT o, i, x.s AS s, row_number() OVER (PARTITION BY o ORDER BY x.count DESC, i) - 1 AS slot FROM best) WHERE slot < {E}),
          pat AS (SELECT b.vec_id, b.o, b.c, b.y, CAST(sum(xor(g.bits[f.i + 1], f.s) << f.slot) AS BIGINT) AS pattern FROM base b JOIN signs g USING (vec_id) JOIN cand f ON f.o = b.o GROUP BY ALL),
          cells2 AS (SELECT o, c, pattern, y, count(*) AS n FROM pat GROUP BY ALL)
          SELECT o, CAST(mask AS INTEGER) AS mask, t, count FROM ({_exp_sql(3)})""",
        "train_benchmark": f"""WITH {_BYTES.replace('doc_id', 'item_id').replace('FROM documents', 'FROM benchmark')}, {_train_sql(4)}
          SELECT h.o, threshold, accuracy, CAST(coalesce(w.i, -1) AS INTEGER) AS i, CAST(coalesce(w.s, -1) AS INTEGER) AS s FROM h4 h LEFT JOIN w4 w ON w.o = h.o""",
        "compare_planes": f"""WITH {_SIGNS}, z AS (SELECT a.vec_id, list_transform(list_zip(a.bits, b.bits), lambda x: 2 * (x[1] - x[2]) + (CASE WHEN a.label % 2 = 0 THEN 1 ELSE 0 END) - (CASE WHEN b.label % 2 = 0 THEN 1 ELSE 0 END)) AS d FROM signs a JOIN signs b ON b.vec_id = a.vec_id + 1)
          SELECT vec_id, CAST(len(list_filter(d, lambda x: x < 0)) AS INTEGER) AS lt, CAST(len(list_filter(d, lambda x: x = 0)) AS INTEGER) AS eq, CAST(len(list_filter(d, lambda x: x > 0)) AS INTEGER) AS gt FROM z""",
        "set_rows": """SELECT c_custkey, repeat('0', CAST(c_custkey % 256 AS INTEGER)) || '1' || repeat('0', CAST(255 - c_custkey % 256 AS INTEGER)) AS shown, true AS there, false AS beside, 1 AS ones FROM customer""",
        "coded_keys": "SELECT c_custkey, " + ", ".join(
            f"CAST(list_sum(list_transform(range({n}), lambda i: {_code('(c_custkey % 256)', 'i', k)})) AS INTEGER) AS {kind}_ones, "
            f"CAST(list_sum(list_transform(range({n}), lambda i: abs({_code('(c_custkey % 256)', 'i', k)} - {_code('c_nationkey', 'i', k)}))) AS INTEGER) AS {kind}_distance, CAST({_code('(c_custkey % 256)', 'c_nationkey', k)} AS INTEGER) AS {kind}_bit"
            for kind, (n, k) in codes.KINDS.items()) + " FROM customer",
        "decoded_keys": f"""WITH k AS (SELECT s_suppkey, d.range::INTEGER AS decoded, CAST(list_sum(list_transform(range(256), lambda i: abs((CASE WHEN i < 64 AND 63 - i < s_nationkey + 37 THEN 1 - {_code('(s_suppkey % 256)', 'i')} ELSE {_code('(s_suppkey % 256)', 'i')} END) - {_code('d.range', 'i')}))) AS INTEGER) AS distance
            FROM supplier, range(256) d)
          SELECT s_suppkey, decoded, distance FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY distance, decoded) AS r FROM k) WHERE r = 1""",
        "sold_filters": f"""WITH {sold}
          SELECT h.o, coalesce(string_agg(w.i || ':' || w.s, ',' ORDER BY w.i), '') AS terms, any_value(threshold || ',' || (threshold + 1) || ',' || (threshold + 2)) AS thresholds,
            CASE WHEN count(w.i) > 0 THEN list_aggregate(list_transform(range(128), lambda k: CASE WHEN list_contains(list(w.i) FILTER (w.s = 1), k) THEN '1' ELSE '0' END), 'string_agg', '') END AS sign,
            CASE WHEN count(w.i) > 0 THEN list_aggregate(list_transform(range(128), lambda k: CASE WHEN list_contains(list(w.i), k) THEN '1' ELSE '0' END), 'string_agg', '') END AS mask
          FROM thresholds h LEFT JOIN weights w ON w.o = h.o GROUP BY h.o""",
        "sold_sparsity": f"WITH {sold} SELECT count(*) AS n_set, 1::DOUBLE - count(*)::DOUBLE / 2048::DOUBLE AS sparsity FROM weights",
        "sold_records": """SELECT CAST(o_custkey % 7 AS INTEGER) AS precision, CAST(o_orderkey % 9 AS INTEGER) AS x, CAST(sum(o_orderkey) + sum(o_custkey) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS y,
          CAST(18446744073709551616::HUGEINT - sum(o_orderkey) AS VARCHAR) AS unit_hash, CAST(18446744073709551616::HUGEINT - sum(o_custkey) AS VARCHAR) AS exp_hash FROM orders WHERE o_custkey % 7 IN (3, 4, 5) GROUP BY 1, 2""",
        "perf_round_trip": """SELECT 'm' AS machine_type, 8 AS n_cores, 0.5::DOUBLE AS price, 'bitslice-BitArray64x8_u4' AS algorithm, CAST(10 * k AS BIGINT) AS unit_nanos, CAST(33 * k AS BIGINT) AS total_nanos,
          CAST(18446744073709551616::HUGEINT - k AS VARCHAR) AS unit_hash FROM (VALUES (1), (2), (3)) AS v(k)""",
    }


def queries() -> dict[str, Query]:
    return {
        "word_bits": word_bits, "word_hamming": word_hamming, "masked_hamming": masked_hamming, "flatten_pairs": flatten_pairs,
        "codebook_256": _codebook("full"), "codebook_thin": _codebook("thin"), "codebook_wide": _codebook("wide"), "encode_bytes": encode_bytes, "decode_noisy": decode_noisy,
        "context_windows": context_windows, "distinct_contexts": distinct_contexts, "distinct_five_grams": distinct_five_grams, "block_transpose": block_transpose,
        "bitslice_add": bitslice_add, "bitslice_compare": bitslice_compare, "lane_logic": lane_logic,
        "unit_counts": unit_counts, "unit_counts_labels": unit_counts_labels, "unit_counts_all": unit_counts_all, "exp_candidates": exp_candidates, "exp_counts": exp_counts, "update_filters": update_filters,
        "sparse_weights": sparse_weights, "dense_weights": dense_weights, "layer_apply": layer_apply, "layer_accuracy": layer_accuracy, "layer_sparsity": layer_sparsity,
        "train_layer": train_layer, "train_stack": train_stack, "synthetic_bits": synthetic_bits, "perf_points": perf_points,
        "stacked_rows": stacked_rows, "lane_transpose_32": lane_transpose_32, "trits": trits, "perf_round_trip": perf_round_trip,
        "stream_contexts": stream_contexts, "wide_windows": wide_windows, "file_contexts": file_contexts, "positional_zip": positional_zip, "chunked_rows": chunked_rows,
        "unit_counts_lanes": unit_counts_lanes, "exp_counts_lanes": exp_counts_lanes, "train_benchmark": train_benchmark,
        "compare_planes": compare_planes, "set_rows": set_rows,
        "coded_keys": coded_keys, "decoded_keys": decoded_keys, "sold_filters": sold_filters, "sold_sparsity": sold_sparsity, "sold_records": sold_records,
    }


def oracle_sql() -> dict[str, str]:
    return _sql()
