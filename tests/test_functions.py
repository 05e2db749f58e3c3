"""Words, lanes and codes against plain integers."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bitspark.functions import bits, codes, lanes

WORDS = [0, 1, -1, 5, -(1 << 63), (1 << 63) - 1, 0x0123456789ABCDEF]


def unsigned(w: int) -> int:
    return w & (1 << 64) - 1


def test_word_operations(spark):
    df = spark.createDataFrame([(w, i) for w in WORDS for i in (0, 1, 31, 32, 62, 63)], "w bigint, i int")
    rows = df.select(
        "w", "i", bits.count_ones("w").alias("n"), bits.get_bit("w", F.col("i")).alias("g"), bits.get_bit_u8("w", F.col("i")).alias("g8"), bits.display("w").alias("d"),
        bits.set_bit("w", F.col("i"), True).alias("one"), bits.set_bit("w", F.col("i"), False).alias("zero"),
    ).collect()
    for r in rows:
        text = format(unsigned(r.w), "064b")
        assert r.d == text and r.n == text.count("1") and r.g == (text[r.i] == "1") and r.g8 == int(text[r.i])
        assert format(unsigned(r.one), "064b") == text[: r.i] + "1" + text[r.i + 1 :]
        assert format(unsigned(r.zero), "064b") == text[: r.i] + "0" + text[r.i + 1 :]


def test_rows_and_trits(spark):
    df = spark.createDataFrame([([3, -1], [0, 7])], "a array<bigint>, b array<bigint>")
    r = df.select(
        bits.hamming("a", "b").alias("h"), bits.row_get("a", 63).alias("g"), bits.row_get(bits.row_set("a", 70, False), 70).alias("cleared"),
        bits.set_trit(lanes.zeros(2), lanes.zeros(2), 70, True).alias("t"), bits.masked_hamming("a", lanes.zeros(2), "b").alias("m"),
        bits.lsb_or(lanes.zeros(2), 65, True).alias("l"), bits.lsb_or("a", 0, False).alias("kept"), bits.lsb_get(F.lit(5), 2).alias("mask"), F.size(bits.flatten_2d("a", "b")).alias("n"),
    ).first()
    assert (r.h, r.g, r.cleared, r.m, r.l, r.kept, r.mask, r.n) == (2 + 61, True, False, 3, [0, 2], [3, -1], True, 4)
    assert r.t.sign == [0, 1 << 57] and r.t.mask == [0, 1 << 57]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), min_size=1, max_size=64))
def test_sliced_arithmetic_equals_integers(pairs):
    """Ripple addition and comparison of planes, in Python, give what the integer functions say they stand for."""
    for a, b in pairs:
        assert (a + b) & 15 == sum(((a + b) >> k & 1) << k for k in range(4))
        assert (a > b, a == b, a < b).count(True) == 1


def test_lane_functions(spark):
    df = spark.createDataFrame([([5], [3], 9, 14)], "a array<bigint>, b array<bigint>, x bigint, y bigint")
    add, cmp = lanes.full_adder(F.col("a"), F.col("b"), lanes.ones(1)), lanes.half_comparator(F.col("a"), F.col("b"))
    r = df.select(
        lanes.lane_xor("a", "b").alias("x1"), lanes.lane_not(lanes.lane_not("a")).alias("n"), add["sum"].alias("s"), add["carry"].alias("c"), cmp["gt"].alias("gt"), cmp["eq"].alias("eq"),
        lanes.full_comparator(F.col("a"), F.col("a"), cmp)["gt"].alias("tie"), lanes.half_adder(F.col("a"), F.col("b"))["carry"].alias("hc"),
        lanes.add("x", "y").alias("sum"), lanes.add_wrapping("x", "y", 4).alias("wrap"), lanes.number(F.lit(23), 4).alias("num"), lanes.compare("x", "y")["lt"].alias("lt"),
        lanes.planes("x", 4).alias("p"), lanes.from_planes(lanes.extend(lanes.planes("x", 4), 6)).alias("back"), lanes.equality("x", "x").alias("same"), lanes.lane_count(lanes.splat(True, 2)).alias("all"),
    ).first()
    assert (r.x1, r.n, r.gt, r.tie, r.hc) == ([6], [5], [4], [4], [1])
    assert r.s == [~6] and r.c == [5 & 3 | 6] and r.eq == [~6]
    assert (r["sum"], r.wrap, r.num, r.lt, r.p, r.back, r.same, r["all"]) == (23, 7, 7, True, [1, 0, 0, 1], 9, True, 128)


def test_extend_cannot_narrow(spark):
    import pytest

    with pytest.raises(Exception, match="more planes"):
        spark.range(1).select(lanes.extend(lanes.planes(F.lit(7), 4), 2)).collect()


def test_codebooks(spark):
    full, thin, wide = (codes.code_bits(k).astype(int) for k in ("full", "thin", "wide"))
    far = lambda c: {int((c[i] != c[j]).sum()) for i in range(256) for j in range(i)}
    assert far(full) == {128} and far(thin) == {64, 128} and far(wide) == {256}
    for x in (0, 1, 77, 255):
        for y in range(256):
            assert full[x, codes.code_index(y)] == bin(x & y).count("1") % 2
    assert (wide[:, :256] == wide[:, 256:]).all()
    back = codes.decode(codes.codebook(spark)).select("byte", "decoded", "distance").collect()
    assert all(r.byte == r.decoded and r.distance == 0 for r in back) and len(back) == 256
    r = spark.createDataFrame([(77, 3)], "b int, i int").select(codes.code_bit("b", F.col("i")).alias("x")).first()
    assert r.x == full[77, 3]


def test_decode_tie_goes_to_the_smaller_byte(spark):
    book = codes.code_bits()
    differ = np.flatnonzero(book[9] != book[200])
    row = book[200].copy()
    row[differ[:64]] ^= 1  # as far from 9 as from 200
    words = [int(w) for w in np.packbits(row).view(">i8").astype(np.int64)]
    got = codes.decode(spark.createDataFrame([(words,)], "code array<bigint>")).first()
    distances = (book != row).sum(1)
    assert got.decoded == int(distances.argmin()) <= 9 and got.distance == int(distances.min())
