"""The audits of filters and sources against brute force, on a table with nulls, copies, repeats, long texts and clashing columns."""

from __future__ import annotations

import collections
import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from bitspark.llm import divergence, filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def label_rows(rows):
    out = [(r[0], k % 2, int(k % 5 == 0)) for k, r in enumerate(rows) if k % 3]
    return out + [(None, 1, 1), (3, None, None), (5, 1, 0), (5, 0, 1), (5, 0, 1), (999, 1, 1)]


@pytest.fixture(scope="session")
def labels(spark, rows):
    return spark.createDataFrame(label_rows(rows), "doc_id bigint, quality int, toxic int")


# ---------------------------------------------------------------- filters


def failed(text, copy):
    w = WORD.findall(text)
    found = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy}
    return {k for k, v in found.items() if v}


def brute_audit(rows, labels):
    """Every order run over the documents, one filter after another."""
    docs = []
    for d, text, lang, _ in rows:
        t = text or ""
        copy = d is not None and any(e is not None and e < d and (u or "") == t for e, u, *_ in rows)
        says = lambda i: d is not None and any(x[0] == d and x[i] == 1 for x in labels)  # noqa: E731, B023
        docs.append((lang or "", failed(t, copy), says(1), says(2)))
    out = set()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        steps, total = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(gone)
                fail = [d for d in own if f in d[1]]
                steps.append(("".join(order), k, f, len(left), len(gone), len(fail) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out |= {(part, o, k, *rest, total[f]) for o, k, f, *rest in steps}
    return out


def test_audit_equals_every_order_run(docs, rows, labels):
    got = filter_audit.audit(docs, labels).collect()
    assert {tuple(r) for r in got} == brute_audit(rows, label_rows(rows))
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_many_copies_ties_and_repeated_ids(spark):
    """Copies over parts, ids that repeat with one text or two, and ids that are null."""
    r = random.Random(4)
    texts = ["", "word " * 120, "One TWO #", " ".join(f"w{k}" for k in range(150)), None]
    rows = [(r.choice([None, *range(12)]), r.choice(texts), r.choice(["en", "de", None, ""]), None) for _ in range(160)]
    told = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(0, 12, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(7)
    got = filter_audit.audit(docs, spark.createDataFrame(told, "doc_id bigint, quality int, toxic int")).collect()
    assert {tuple(x) for x in got} == brute_audit(rows, told)


def test_no_documents_and_no_labels(spark, empty, docs, rows):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(empty, none).collect() == []
    got = filter_audit.audit(docs, none).collect()
    assert {tuple(r) for r in got} == brute_audit(rows, [])


@pytest.mark.parametrize("k", [1, 3, 4])
def test_polynomial_has_the_corners_and_values_of_the_game(k):
    r = random.Random(k)
    counts = [(m, r.randrange(50)) for m in range(1 << k)]
    p = filter_audit.Removals.of(counts)
    for chosen in range(1 << k):
        assert p.corner(chosen) == sum(n for m, n in counts if m & chosen)
    for i in range(k):
        # a document's removal is shared evenly by the filters that it fails
        assert p.shapley(i) == sum((Fraction(n, m.bit_count()) for m, n in counts if m >> i & 1), Fraction(0))
    assert sum((p.shapley(i) for i in range(k)), Fraction(0)) == p.corner((1 << k) - 1)


def test_other_filters_than_five(spark):
    counts = spark.createDataFrame([("x", 1, 4, 1, 0), ("x", 3, 2, 0, 2), ("x", 0, 5, 5, 0)], "part string, mask int, n bigint, n_good bigint, n_toxic bigint")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.all_orders(counts, "PQ").collect()}
    assert got == {("PQ", 1): (5, 6, 0, 4, 1, 2, 10), ("PQ", 2): (5, 0, 2, 0, 0, 0, 2), ("QP", 1): (9, 2, 0, 0, 0, 2, 2), ("QP", 2): (5, 4, 2, 4, 1, 0, 10)}
    with pytest.raises(ValueError, match="letters"):
        filter_audit.all_orders(counts, "AA")


# ---------------------------------------------------------------- sources

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def odd_texts(rows):
    r = random.Random(1)
    runs = ["x" * n + y for n in range(1, 70) for y in ("", "y")]
    return [r_[1] or "" for r_ in rows] + ["", "a", "A1b2", "\x00a\x7fb[c`d{e", "é" * 40, "東京" * 30 + " " + "東京" * 30, " ".join(r.choices(runs, k=400)), "end", "Beginning"]


def test_hashes_are_xxhash(rows):
    low, starts, sizes, _ = divergence.slices(*joined(odd_texts(rows)))
    got = divergence.hashes(low, divergence._lanes(low), starts, sizes)
    assert max(sizes) > 64 and min(sizes) == 1
    assert got.tolist() == [xxhash.xxh64_intdigest(low[s : s + n].tobytes()) for s, n in zip(starts, sizes, strict=True)]


@pytest.mark.parametrize("bits", [64, 4, 0])
def test_terms_of_one_hash_are_told_apart_by_their_bytes(rows, bits):
    data, offsets = joined(odd_texts(rows))
    low, starts, sizes, texts = divergence.slices(data, offsets)
    weak = lambda *a: divergence.hashes(*a) & np.uint64((1 << bits) - 1)
    order, term, example = divergence.grouped(low, starts, sizes, weak)
    word = [low[s : s + n].tobytes() for s, n in zip(starts, sizes, strict=True)]
    assert sorted(order.tolist()) == list(range(len(starts))) and (np.diff(term) >= 0).all()
    assert [word[example[t]] for t in term] == [word[k] for k in order] and len(example) == len(set(word))
    assert all(texts[a] <= texts[b] for a, b, s, t in zip(order, order[1:], term, term[1:], strict=False) if s == t)


def test_counts_of_a_buffer(rows):
    texts = odd_texts(rows)
    group = np.arange(len(texts)) % 3
    for limit in (10**9, 300, 7):
        got, held = collections.Counter(), collections.Counter()
        for names, at, n, docs in divergence._texts_of(*joined(texts), group, 3, limit):
            for name, g, a, b in zip(names.to_pylist(), at.tolist(), n.tolist(), docs.tolist(), strict=True):
                got[g, name] += a
                held[g, name] += b
        assert got == collections.Counter((k % 3, w) for k, t in enumerate(texts) for w in terms(t))
        assert held == collections.Counter((k % 3, w) for k, t in enumerate(texts) for w in set(terms(t)))


def test_shares_are_exact():
    r = random.Random(2)
    totals = [r.randrange(1, 9 * 10**15) for _ in range(200)] + [1, 2, 9 * 10**15 - 1]
    counts = [r.randrange(t) for t in totals]
    assert divergence.shares(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts, totals, strict=True)]


def brute_divergences(rows, least=3, most=200):
    rows = [(t, lang or "", source or "") for _, t, lang, source in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == lang]
        held = collections.Counter(w for r in own for w in set(terms(r[0])))
        kept = {w for w, n in held.items() if n >= least}
        count = {s: collections.Counter(w for r in own if r[2] == s for w in terms(r[0]) if w in kept) for s in {r[2] for r in own}}
        whole = sum(count.values(), collections.Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))  # noqa: E731, B023
        for s, c in count.items():
            pairs = [(sum((share(c, w) - share(d, w)) ** 2 // share(d, w) for w in kept), t) for t, d in count.items() if t != s]
            above = [((share(c, w) - share(whole, w)) ** 2 // share(whole, w), w) for w in c if share(c, w) > share(whole, w)]
            for part, found in (("pair", pairs), ("term", above)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= most}
    return out


def test_divergences_equal_brute_force(docs, rows, monkeypatch):
    got = [tuple(r) for r in divergence.audit_sources(docs).collect()]
    assert set(got) == brute_divergences(rows) and len(got) == len(set(got))
    monkeypatch.setattr(divergence, "BLOCK_ENTRIES", 40)  # many blocks of each language
    got = [tuple(r) for r in divergence.audit_sources(docs, min_docs=2, most=5).collect()]
    assert set(got) == brute_divergences(rows, 2, 5) and len(got) == len(set(got))


def test_groups_without_terms(spark, empty):
    assert divergence.audit_sources(empty).collect() == []
    rows = [(1, "a b", "en", "x"), (2, None, "en", "y"), (3, "1 2", None, None), (4, "", "", "z"), (5, "solo", "de", "x")]
    got = {tuple(r) for r in divergence.audit_sources(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert got == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1), ("", "", "pair", "z", 0, 1), ("", "z", "pair", "", 0, 1)} == brute_divergences(rows)
