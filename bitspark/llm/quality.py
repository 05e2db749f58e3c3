"""Quality rules with robust multivariate outliers.

Each text becomes a few counts, and these a vector of transformed rates.  Per language and source a
minimum covariance determinant estimate of centre and scatter is found by concentration steps from several
fixed starts: keep the ``h`` share of vectors nearest to the centre, take their mean and covariance, repeat;
the end with the least determinant is the estimate.  Vectors too far from their group's estimate by Mahalanobis distance
are rejected, as are texts that fail two plain rules.  DataFrame operations only: quantiles and moments
are mergeable aggregates, so a hot group costs no task more than its share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitspark.llm.scratch import Stored, small

FEATURES = ("word_length", "symbol_rate", "dup_line_rate", "repeat_rate")
#: Least standard deviation of each feature: rates that are zero in most clean texts have no spread of their own.
#: Five of them (the root of the cutoff) lie inside what a text that passes the plain rules can reach, so that
#: each feature can reject by itself: a third of the lines, a quarter of the words or a symbol in four words.
FLOORS = (0.05, 0.10, 0.12, 0.10)
PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
SPLIT = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPLIT), "")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text."""
    windows = F.when(F.size(words) > 3, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )).otherwise(F.array().cast("array<bigint>"))

    def spread(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def covered(s: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (
                F.coalesce(F.get(s, i - 1)["h"] == F.get(s, i)["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == F.get(s, i)["h"], F.lit(False))
            ))
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: let(F.get(s, i)["p"], lambda p: F.array(p, p + 1, p + 2))))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, covered))

    return let(windows, spread)


def statistics(text: Column) -> Column:
    """Struct of ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``, all bigint, of a text; null is empty.

    Lines are split at line feeds; only lines with a word count.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct")))
    return let(text_words(text), lambda w: let(line_counts, lambda n: F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        n["all"].cast("bigint").alias("n_lines"),
        (n["all"] - n["distinct"]).cast("bigint").alias("n_dup_lines"),
        _repeat_words(w).cast("bigint").alias("n_repeat_words"),
    )))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def features() -> list[Column]:
    """Logarithm of the mean word length, and square roots of rates, which steady their variance."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words).alias(FEATURES[0]),
        F.sqrt(F.col("n_symbols") / words).alias(FEATURES[1]),
        F.sqrt(F.col("n_dup_lines") / lines).alias(FEATURES[2]),
        F.sqrt(F.col("n_repeat_words") / words).alias(FEATURES[3]),
    ]


def level_keys(lang: Column, source: Column) -> Column:
    """Group keys from fine to coarse: language and source, language, everything."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.array(F.concat(F.lit("2"), F.to_json(F.array(mark(lang), mark(source)))), F.concat(F.lit("1"), mark(lang)), F.lit("0"))


def consistency(h: float) -> float:
    """Factor that makes the covariance of the nearest ``h`` share of four-dimensional normal vectors that of all."""
    low, high = 0.0, 100.0
    for _ in range(80):
        x = (low + high) / 2
        low, high = (x, high) if 1 - math.exp(-x / 2) * (1 + x / 2) < h else (low, x)
    return h / (1 - math.exp(-low / 2) * (1 + low / 2 + low * low / 8))


def _distance(x: list[Column], p: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor."""
    y: list[Column] = []
    for i in range(len(FEATURES)):
        rest = x[i] - F.col(f"{p}m{i}")
        for j in range(i):
            rest = rest - F.col(f"{p}l{i}{j}") * y[j]
        y.append(rest / F.col(f"{p}l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _cholesky(groups: DataFrame, factor: float) -> DataFrame:
    """``key, start, n, m*, c*`` (means, covariances) -> ``key, start, n, m*, l*``."""
    for i in range(len(FEATURES)):
        for j in range(i + 1):
            v = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0)) * F.lit(factor) + F.lit(FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            groups = groups.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(FLOORS[i] ** 2 / 4))) if i == j else v / F.col(f"l{j}{j}"))
    return groups.select("key", "start", "n", *[f"m{i}" for i in range(len(FEATURES))], *[f"l{i}{j}" for i, j in PAIRS])


def _moments(rows: DataFrame, *keys: str, count: bool = False) -> DataFrame:
    many = [F.count("*").alias("n")] if count else []
    return rows.groupBy(*keys).agg(*many, *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)], *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i, j in PAIRS])


def _nearest(vectors: DataFrame, now: DataFrame, h: float) -> DataFrame:
    """Moments of the ``h`` share of each group's vectors that is nearest to each of its estimates so far."""
    near = vectors.join(small(now), "key").withColumn("d", _distance([F.col(f) for f in FEATURES]))
    cut = Stored(near.groupBy("key", "start").agg(F.percentile_approx("d", h, 1000).alias("cut")), "cut")
    return _moments(near.join(small(cut.df), ["key", "start"]).where("d <= cut"), "key", "start", "n")


def fit(vectors: DataFrame, *, h: float = 0.75, steps: int = 4) -> Stored:
    """Estimates ``key, n, m*, l*`` for every group of ``vectors(key, features...)``.

    Concentration steps go from three starts: medians with quartile ranges, the moments of all vectors, and
    those of the half nearest to the first start.  A step never raises the determinant but may end in a local
    minimum, so of the three ends the one with the least determinant is a group's estimate.
    """
    quartiles = vectors.groupBy("key").agg(F.count("*").alias("n"), *[F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, f in enumerate(FEATURES)])
    middle = quartiles.select(
        "key", F.lit(0).alias("start"), "n", *[F.get(f"q{i}", F.lit(1)).alias(f"m{i}") for i in range(len(FEATURES))],
        *[((F.pow((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349, F.lit(2.0))) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS],
    )
    first = Stored(_cholesky(middle, 1.0), "mcd")
    everything = _cholesky(_moments(vectors, "key", count=True).withColumn("start", F.lit(1)), 1.0)
    half = _cholesky(_nearest(vectors, first.df, 0.5), consistency(0.5)).withColumn("start", F.lit(2))
    now = Stored(first.df.union(everything).union(half), "mcd")
    for _ in range(steps):
        after = Stored(_cholesky(_nearest(vectors, now.df, h), consistency(h)), "mcd")
        now.drop()
        now = after
    determinant = sum((F.log(f"l{i}{i}") for i in range(1, len(FEATURES))), F.log("l00"))
    rest = [c for c in now.df.columns if c not in ("key", "start")]
    best = now.df.groupBy("key").agg(F.min(F.struct(F.round(determinant, 9).alias("det"), "start", *rest)).alias("b"))
    return Stored(best.select("key", *[f"b.{c}" for c in rest]), "mcd")


def judge(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = 25.0, min_group: int = 50, h: float = 0.75, steps: int = 4,
) -> DataFrame:
    """Counts and verdict of every document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept``.

    A text fails the plain rules if it has under 50 words or if over half of its words lie in repeated
    three-word windows.  Estimates are of all texts that pass; a text is measured against its language
    and source if that group has ``min_group`` such texts, else against its language, else against all,
    and rejected if the squared distance exceeds ``cutoff``.  ``cutoff`` 25 is passed by one in 20,000
    normal vectors.  If no group is large enough, passing texts are kept, with distance null.

    A null text is empty and fails; a null language or source is a value of its own; a null id is kept
    as null; repeated rows give repeated rows; constant features have a floor of spread.  Other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    pick = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), statistics(F.col(f"`{text}`")).alias("s"))
    flat = pick.select("doc_id", level_keys(F.col("lang"), F.col("source")).alias("levels"), "s.*").withColumn("base_failed", base_failed())
    counted = Stored(flat.select("*", *features()), "stats").df
    groups = estimates(counted, min_group=min_group, h=h, steps=steps)
    passing = measure(counted.where("not base_failed"), groups)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = passing.select(*cols, "distance", (F.coalesce("distance", F.lit(0.0)) <= cutoff).alias("kept"))
    return good.union(counted.where("base_failed").select(*cols, F.lit(None).cast("double"), F.lit(False)))


def estimates(counted: DataFrame, *, min_group: int, h: float, steps: int) -> DataFrame:
    """Estimates of the groups with at least ``min_group`` passing texts."""
    vectors = counted.where("not base_failed").select(F.explode("levels").alias("key"), *FEATURES)
    return fit(vectors, h=h, steps=steps).df.where(F.col("n") >= min_group)


def measure(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with ``distance`` from the finest of their ``levels`` that has an estimate, null without any."""
    groups = small(groups)
    for k, name in enumerate(("fine", "lang", "all")):
        named = groups.select(F.col("key").alias(f"{name}_key"), *[F.col(c).alias(f"{name}_{c}") for c in groups.columns if c not in ("key", "n")])
        rows = rows.withColumn("at", F.get("levels", F.lit(k))).join(named, F.col("at") == F.col(f"{name}_key"), "left").drop("at")
    x = [F.col(f) for f in FEATURES]
    return rows.withColumn("distance", F.coalesce(*[F.when(F.col(f"{n}_key").isNotNull(), _distance(x, f"{n}_")) for n in ("fine", "lang", "all")]))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose documents are kept, with their columns; see ``judge``.

    Every row is written once with its counts to the shared folder, so that each has its own verdict,
    whatever its id, and no text is counted twice: repeated rows stay repeated, and a null id is no reason to
    go.  Null and blank texts fail the plain rules.  An empty table gives an empty one.
    """
    o = {"lang": "lang", "source": "source", "text": "text", "cutoff": 25.0, "min_group": 50, "h": 0.75, "steps": 4} | options
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), level_keys(F.col(f"`{o['lang']}`"), F.col(f"`{o['source']}`")).alias("levels"), statistics(F.col(f"`{o['text']}`")).alias("s")
    )
    counted = own.select("__row", "levels", "s.*").withColumn("base_failed", base_failed()).where("not base_failed").select("*", *features())
    stored = Stored(counted, "counted", "zstd").df
    groups = estimates(stored, min_group=o["min_group"], h=o["h"], steps=o["steps"])
    return measure(stored, groups).where(F.coalesce("distance", F.lit(0.0)) <= o["cutoff"]).select("__row.*")
