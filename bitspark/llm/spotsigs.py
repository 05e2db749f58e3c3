"""SpotSigs document fingerprints.

A spot signature is a common word (the anchor) with the chain of content words that follows it; in a run
of content words every ``RUN`` of them stand for an anchor, so that tables and lists have signatures too.
A text's fingerprint is its set of signatures, each hashed to 32 bits.  Advertising and navigation have few common
words, so prose dominates the set.  Sets are partitioned by length so that only neighbouring partitions
can hold sets that are similar enough, and are compared by a Jaccard likeness that gives up when sizes, or a
quarter of the signatures, rule the threshold out.  DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bitspark.llm.quality import let
from bitspark.llm.scratch import Stored

# Common function words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "aber als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie zu zum zur "
    "au aux avec ce ces cette dans de du elle en est et il je la le les leur lui mais ne nous ou où par pas plus pour que qui sa sans se ses son sur un une vous "
    "al como con cuando del el ella ellos entre esta este están fue ha hay la las lo los más me mi muy no o para pero por porque se si sin sobre su sus también un una y ya"
)
CHAIN = 2
RUN = 5
QUARTER = -(1 << 30)
#: A set's least signature in three orders of the numbers, by turning some of their bits.
TURNS = (0, 0x55555555, -0x55555556)
MARK = "\u0001"


def _marked(text: Column) -> Column:
    """`` w`` for a content word, MARK w for an anchor and MARK after a run, in order; case and ASCII punctuation are dropped."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]+", "")
    words = F.array_remove(F.split(plain, r"[\x20\x09-\x0D]+"), "")
    anchors = sorted(set(ANCHORS.split()))  # over ten literals become one hash set
    marked = F.array_join(F.transform(words, lambda w: F.concat(F.when(w.isin(anchors), F.lit(MARK)).otherwise(F.lit(" ")), w)), "")
    return F.regexp_replace(marked, f"(?: [^ {MARK}]+){{{RUN}}}(?= )", f"$0{MARK}")


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct 32-bit signatures (int) of a text.

    A text without any has the chains after its words instead, and one too short for that has a single
    signature of its words; null and blank texts have none.  The work is linear in the text: it is cut at its
    content words, so that the anchors before a content word lie in one piece and share the chain of the next pieces.
    """
    every = f"(?=({''.join(f'[ {MARK}][^ {MARK}]++' for _ in range(chain + 1))}))"
    hashed = lambda found: F.sort_array(F.array_distinct(F.transform(found, lambda x: F.hash(x))))

    def spots(pieces: Column) -> Column:
        def of(words: Column) -> Column:
            def after(k: Column) -> Column:
                following = F.concat(*[x for j in range(1, chain + 1) for x in (F.lit(" "), F.get(words, k + j))])
                anchors = let(F.split(F.get(pieces, k), MARK), lambda a: F.array_distinct(F.slice(a, F.lit(2), F.size(a))))
                return let(following, lambda c: F.transform(anchors, lambda x: F.concat(F.lit(MARK), x, c)))

            places = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda k: (k < F.size(pieces) - chain) & F.contains(F.get(pieces, k), F.lit(MARK)))
            return hashed(F.flatten(F.transform(places, after)))

        return let(F.transform(pieces, lambda p: F.substring_index(p, MARK, 1)), of)

    def of(m: Column) -> Column:
        def enough(found: Column) -> Column:
            rest = let(hashed(F.regexp_extract_all(m, F.lit(every), F.lit(1))), lambda a: (
                F.when(F.size(a) > 0, a).when(F.length(m) > 0, F.array(F.hash(m))).otherwise(a)
            ))
            return F.when(F.size(found) > 0, found).otherwise(rest)

        return let(let(F.split(m, " "), spots), enough)

    return let(_marked(text), of)


def encode(sigs: Column) -> Column:
    """Fingerprint as text: eight hexadecimal digits a signature, in order."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets, 0 where it can't reach ``at_least``; two empty sets are alike.

    Sizes are compared first.  Then only the signatures below ``QUARTER`` meet, about a fourth of either set: if
    those in common and all that may still come don't reach what ``at_least`` asks for, the rest isn't looked at.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    exact = let(F.size(F.array_intersect(a, b)), lambda c: c / (small + large - c))
    if at_least > 0:
        low = lambda s: F.filter(s, lambda x: x < QUARTER)
        enough = at_least / (1 + at_least) * (small + large) - 1e-9  # common signatures that the likeness asks for
        most = let(low(a), lambda x: let(low(b), lambda y: F.size(F.array_intersect(x, y)) + F.least(F.size(a) - F.size(x), F.size(b) - F.size(y))))
        exact = F.when(most < enough, F.lit(0.0)).otherwise(exact)
    return F.when(large == 0, F.lit(1.0)).when(small < at_least * large, F.lit(0.0)).otherwise(exact).cast("double")


def length_partition(size: Column, threshold: float) -> Column:
    """Partition of a set by its size: sets that reach ``threshold`` are in the same or in neighbouring partitions."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / F.lit(-math.log(threshold)) + 1e-9)).otherwise(-1).cast("int")


def search(queries: DataFrame, rows: DataFrame, *, threshold: float = 0.75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All ``(query_id, doc_id, likeness)`` with ``likeness`` of ``threshold`` or more, a query's own id excepted.

    ``queries`` and ``rows`` hold the id and text columns; each query meets the rows of its own and of the
    neighbouring length partitions with which it shares a signature of its prefix.  Rows with null ids or
    empty fingerprints match nothing.  Repeated rows, equal in id and fingerprint, give each match once; different
    texts under one id give the greatest likeness.
    """
    make = lambda df: df.select(F.col(f"`{doc_id}`").alias("id"), signatures(F.col(f"`{text}`")).alias("sigs")).where("size(sigs) > 0").withColumn("part", length_partition(F.size("sigs"), threshold))
    prefix = lambda s: F.slice(s, 1, (F.size(s) - F.ceil(F.lit(threshold) * F.size(s) - 1e-9) + 1).cast("int"))
    stored = Stored(make(rows), "spots").df
    left = make(queries).withColumn("near", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)))
    left = left.withColumn("sig", F.explode(prefix(F.col("sigs")))).select(F.col("id").alias("query_id"), F.col("sigs").alias("q"), "near", "sig")
    keyed = stored.select("id", "part", F.size("sigs").alias("n"), F.explode(prefix(F.col("sigs"))).alias("sig"))
    met = left.join(keyed, (left["near"] == keyed["part"]) & (left["sig"] == keyed["sig"]) & (F.least("n", F.size("q")) >= threshold * F.greatest("n", F.size("q")))).select("query_id", "q", "id").distinct()
    pairs = met.where("query_id <> id").join(stored.select("id", "sigs"), "id").withColumn("likeness", likeness(F.col("q"), F.col("sigs"), threshold))
    return pairs.where(F.col("likeness") >= threshold).groupBy("query_id", F.col("id").alias("doc_id")).agg(F.max("likeness").alias("likeness"))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, text, sigs, next_text, next_sigs``: with the following document by descending id, after the last the first.

    Ids are cut into ranges, about the square root of the row count of them, by quantiles and evenly
    within a quantile; each range is put in order on its own, with the first row of the following range
    as a guest at its end.  The texts move once, and signatures are made of each where they have come to
    rest.  Equal ids are ordered by a hash of their text; null ids come last, dealt by that hash.
    """
    docs = docs.withColumn("tie", F.xxhash64("text"))
    quantiles = 256
    stats = docs.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [k / quantiles for k in range(1, quantiles)], 10_000).alias("q"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    bounds = sorted({stats["low"], *stats["q"]} - {None}) if stats["q"] else [0]
    split = max(1, math.ceil(4 * math.sqrt(stats["n"]) / quantiles))
    edges = F.array(*[F.lit(b).cast("bigint") for b in [*bounds, (stats["high"] if stats["high"] is not None else 0) + 1]])
    at = F.size(F.filter(edges, lambda e: e <= F.col("doc_id")))  # from 1

    def place(k: Column) -> Column:
        low, high = F.get(edges, k - 1), F.get(edges, k)
        return k * split + F.least(F.lit(split - 1), F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1)) * split))

    nowhere = -1 - F.shiftrightunsigned("tie", 1) % F.lit(max(1, math.ceil(math.sqrt(stats["n"]))))  # below all others, in falling order of cells
    docs = docs.withColumn("cell", F.coalesce(let(at, place), nowhere).cast("bigint"))
    firsts = docs.groupBy("cell").agg(F.max(F.struct("doc_id", "tie")).alias("f"))
    # of rows that are equal in id and hash any one is the guest: their texts are equal
    order = W.orderBy(F.col("cell").desc())
    above = F.coalesce(F.lag("cell").over(order), F.min("cell").over(W.partitionBy(F.lit(1))))
    guests = Stored(firsts.select("cell", "f", above.alias("to")).select(F.col("f.doc_id").alias("g_id"), F.col("f.tie").alias("g_tie"), "to"), "guests").df
    same = F.col("doc_id").eqNullSafe(F.col("g_id")) & F.col("tie").eqNullSafe(F.col("g_tie"))
    guest_rows = docs.join(guests, same).select("doc_id", "text", "tie", F.col("to").alias("cell"), F.lit(1).alias("guest"))
    rows = docs.select("doc_id", "text", "tie", "cell", F.lit(0).alias("guest")).union(guest_rows)
    inside = W.partitionBy("cell").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    made = rows.repartition("cell").withColumn("sigs", signatures(F.col("text")))
    following = made.select("*", F.lead("text").over(inside).alias("next_text"), F.lead("sigs").over(inside).alias("next_sigs"))
    return following.where("guest = 0").select("doc_id", "text", "sigs", "next_text", "next_sigs")


def leading(sets: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``sets(doc_id, k, sigs)`` -> ``doc_id, k, may array<struct<leader, led>>`` of those that a leader may have, ``led`` being its set, or null if it is the same.

    Sets lie in buckets of a length partition and their least signature, in three orders of signatures; a
    bucket is led by its smallest (doc_id, k).  A set's leader is the smallest one before it that leads one of its buckets in
    its own or a neighbouring partition and that it is alike to by ``threshold``.  Sizes prune before sets
    are fetched, and equal keys need no comparison.  That is three min-hashes of a fingerprint's kin, nine sets at most for
    each, linear in the rows whatever the size of a group; all kin of given queries are what ``search`` finds.  Null ids neither
    lead nor follow.
    """
    turned = lambda t: F.array_min(F.transform("sigs", lambda x: x.bitwiseXOR(F.lit(t))))
    least = F.array(*[F.struct(F.lit(t).alias("turn"), turned(t).alias("sig")) for t in TURNS])
    keyed = sets.where("doc_id is not null and size(sigs) > 0").select("doc_id", "k", F.size("sigs").alias("n"), length_partition(F.size("sigs"), threshold).alias("part"), F.explode(least).alias("least"))
    heads = keyed.groupBy("part", "least").agg(F.min(F.struct("doc_id", "k", "n")).alias("head"))
    heads = heads.select("least", "head", F.explode(F.array(F.col("part") - 1, "part", F.col("part") + 1)).alias("part"))
    near = F.least("n", "head.n") >= threshold * F.greatest("n", "head.n")
    met = keyed.join(heads, ["part", "least"]).where(near & (F.struct("head.doc_id", "head.k") < F.struct("doc_id", "k"))).select("doc_id", "k", F.col("head.doc_id").alias("leader"), F.col("head.k").alias("l")).distinct()
    met = Stored(met, "met").df
    other = sets.select(F.col("doc_id").alias("leader"), F.col("k").alias("l"), F.col("sigs").alias("led")).dropDuplicates(["leader", "l"])
    unlike = met.where("k <> l").join(other, ["leader", "l"]).select("doc_id", "k", "leader", "led")
    same = met.where("k = l").select("doc_id", "k", "leader", F.lit(None).cast("array<int>").alias("led"))
    return same.union(unlike).groupBy("doc_id", "k").agg(F.collect_list(F.struct("leader", "led")).alias("may"))


def leader_of(sigs: Column, may: Column, threshold: float) -> Column:
    """Struct of the smallest ``leader`` to which the set is alike, and that likeness; null without any."""
    near = F.transform(may, lambda c: F.struct(c["leader"].alias("leader"), F.when(c["led"].isNull(), F.lit(1.0)).otherwise(likeness(sigs, c["led"], threshold)).alias("near")))
    return F.array_min(F.filter(near, lambda x: x["near"] >= threshold))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.75) -> DataFrame:
    """Fingerprint every document and its edited text: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, leader, near_leader``.

    The edited text is the text with its last third (rounded down, in code points) replaced by as many
    first code points, or all, of the next document by descending id; the last is followed by the first.
    ``near_edited`` and ``near_next`` are likenesses to the edited text and to the next document.
    ``leader`` is the document that heads one of this one's buckets (see ``leading``) and ``near_leader`` its
    likeness; both are null for a document that heads its own or is alike to no head.  Null
    texts are empty; their fingerprint is empty and like only another empty one.  Equal texts have equal
    fingerprints; repeated rows follow each other.  A table of one row is followed by itself.  Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = with_next(own)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    made = rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", edited)
    sets = made.select(
        "doc_id", "n_chars", "sigs", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        let(signatures(F.col("edited")), lambda e: F.struct(e.alias("sigs"), likeness(F.col("sigs"), e).alias("near"))).alias("edited"),
    )
    stored = Stored(sets.withColumn("k", F.xxhash64("sigs")), "fingerprints").df
    may = leading(stored, threshold).select(F.col("doc_id").alias("i"), F.col("k").alias("l"), "may")
    led = stored.join(may, (F.col("doc_id") == F.col("i")) & (F.col("k") == F.col("l")), "left").withColumn("led", leader_of(F.col("sigs"), F.col("may"), threshold))
    return led.select(
        "doc_id", "n_chars", "edited_sha256", encode(F.col("sigs")).alias("fingerprint"), encode(F.col("edited.sigs")).alias("edited_fingerprint"), F.col("edited.near").alias("near_edited"), "near_next", "led.leader", F.col("led.near").alias("near_leader"),
    )
