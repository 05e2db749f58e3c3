"""Keyed pseudorandom permutations of index ranges, as column expressions.

``permuted`` writes x in [0, n) as a pair of digits, of bases a and b about the square root of n, and adds to
one digit a keyed function of the other, in turns: a Feistel network on two residue rings.  Every round can
be undone, so all rounds are one-to-one on [0, a b).  An image beyond n is permuted again until it falls
below (cycle-walking), which keeps it one-to-one on [0, n); less than a of the images are beyond, so a walk
is hardly ever longer than a step.  Any n has all rounds, and a function that no few rounds repeat.
Constants come from a rule and a seed, and only 64-bit integer arithmetic is used, so that plain SQL can
follow it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2_147_483_647
ROUNDS = 8
WALKS = 16  # enough for any n up to 256; beyond, one walk in 16^16 would need more and raises


def round_constants(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int, int]]:
    """Four numbers a round, from a linear congruential generator."""
    out, x = [], (seed * 2_654_435_761 + 12_345) % PRIME
    for _ in range(rounds):
        row = []
        for _ in range(4):
            x = (x * 48_271 + 11) % PRIME
            row.append(x)
        out.append((row[0], row[1], row[2], row[3]))
    return out


def _div(x: Column, y: Column) -> Column:
    """Whole quotient; the quotient of doubles would be inexact beyond 2^53."""
    return F.call_function("div", x, y)


def permuted(x: Column, n: Column, key: Column, seed: int) -> Column:
    """Image of ``x`` in [0, n), n below 2^61, under the permutation of ``key`` (a non-negative integer) and ``seed``."""
    p = F.lit(PRIME).cast("bigint")
    rounds = F.array(*[
        F.struct(F.lit(i % 2 == 0).alias("even"), *[F.lit(v).cast("bigint").alias(k) for k, v in zip("abcd", r, strict=True)]) for i, r in enumerate(round_constants(seed))
    ])
    k1 = (key + 1) % p
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    b = _div(n + a - 1, a)

    def step(s: Column, r: Column) -> Column:
        def turned(y: Column) -> Column:
            z = (y * y % p * y + r["d"]) % p
            return F.when(r["even"], F.struct(((s["l"] + z) % a).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + z) % b).alias("r")))

        y = (F.when(r["even"], s["r"]).otherwise(s["l"]) % p * r["a"] % p + k1 * r["b"] % p + r["c"]) % p
        return F.get(F.transform(F.array(y), turned), F.lit(0))

    def once(v: Column) -> Column:
        start = F.struct(_div(v, b).alias("l"), (v % b).alias("r"))
        return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(x.cast("bigint")), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    late = F.raise_error(F.lit("a permutation's walk did not end")).cast("bigint")
    return F.get(F.transform(F.array(walked), lambda v: F.when(v < n, v).otherwise(late)), F.lit(0))


def permuted_sql(source: str, seed: int) -> str:
    """One application in SQL: ``source`` gives columns ``v, n, k1`` among others, and ``v`` is replaced."""
    p = PRIME
    q = f"SELECT *, v // b AS l, v % b AS r FROM (SELECT *, (n + a - 1) // a AS b FROM (SELECT *, CAST(ceil(sqrt(CAST(n AS DOUBLE))) AS BIGINT) AS a FROM ({source})))"
    for i, (a, b, c, d) in enumerate(round_constants(seed)):
        q = f"SELECT *, ({'r' if i % 2 == 0 else 'l'} % {p} * {a} % {p} + k1 * {b} % {p} + {c}) % {p} AS y FROM ({q})"
        turn = f"(y * y % {p} * y + {d}) % {p}"
        q = f"SELECT * EXCLUDE (y, {'l' if i % 2 == 0 else 'r'}), " + (f"(l + {turn}) % a AS l" if i % 2 == 0 else f"(r + {turn}) % b AS r") + f" FROM ({q})"
    return f"SELECT * EXCLUDE (v, a, b, l, r), l * b + r AS v FROM ({q})"
