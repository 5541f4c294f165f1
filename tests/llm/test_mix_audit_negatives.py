"""Mixing, divergence of sources and hard negatives against brute force, and their odd cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plenum.llm import divergence, hard_negatives, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# Mixing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 5)), max_size=12), st.integers(0, 300), st.integers(1, 4))
def test_water_fill(pairs, budget, epochs):
    """A level of which each source has its weight, or its cap; all of the budget unless all weighted sources are full."""
    sizes, weights = [n for n, _ in pairs], [w for _, w in pairs]
    targets = mixing.water_fill(sizes, weights, budget, epochs)
    caps = [epochs * n if w else 0 for n, w in pairs]
    assert all(0 <= t <= c for t, c in zip(targets, caps, strict=True))
    assert sum(targets) == min(budget, sum(caps))
    level = max([t / w for t, w, c in zip(targets, weights, caps, strict=True) if w and t < c], default=None)
    if level is not None:
        assert all(t == min(Fraction(c), w * level) for t, w, c in zip(targets, weights, caps, strict=True))


def check_mix(rows, docs, seed=42):
    """rows: what mix() returned; docs: (id, text, source)."""
    size = lambda t: len(WORD.findall(t or ""))
    of = defaultdict(int)
    for _, t, s in docs:
        of[s] += size(t)
    assert Counter((r["doc_id"], r["source"], r["size"], r["source_size"]) for r in rows) == Counter((k, s, size(t), of[s]) for k, t, s in docs)
    names = sorted(of, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.water_fill([of[s] for s in names], [1 + k % 3 for k in range(len(names))], sum(of.values())), strict=True))
    taken = defaultdict(int)
    for r in rows:
        assert r["target"] == float(targets[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= Fraction(1, 2) for s in names)
    for s in names:  # all but one document have whole passes, and their numbers are next to each other
        passes = [Fraction(r["taken"], r["size"]) for r in rows if r["source"] == s and r["size"]]
        assert len({p for p in passes if p.denominator == 1}) <= 2 and sum(p.denominator > 1 for p in passes) <= 1


def test_mix_of_odd_rows(docs, odd_rows):
    check_mix(mixing.mix(docs).collect(), [r[:2] + (r[3],) for r in odd_rows])


def test_mix_by_digits(spark, docs, odd_rows, monkeypatch):
    """The same rows whether a window orders all of a source's, or digits of the hash leave it few; at any number of partitions."""
    want = Counter(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "ORDERED", 1)
    rows = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == want
    check_mix(rows, [r[:2] + (r[3],) for r in odd_rows])
    assert Counter(map(tuple, mixing.mix(docs, seed=7).collect())) != want


def test_mix_of_equal_rows(spark, monkeypatch):
    """Equal rows tie in every digit of the hash: their numbers part them."""
    monkeypatch.setattr(mixing, "ORDERED", 20)
    docs = [(None if k % 2 else 3, "one two three", "a") for k in range(400)] + [(k, f"b{k}", "b") for k in range(3000)]
    check_mix(mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect(), docs)


def test_mix_with_weights_and_repetitions(spark, docs, no_docs):
    mixed = mixing.mix(docs, weigh=lambda names: [1 if n == "s0" else 0 for n in names], budget=10**9)
    assert mixed.filter("source = 's0' and taken <> 3 * size or source <> 's0' and taken > 0 or source is null and taken > 0").count() == 0
    mixed = mixing.mix(docs)
    of = lambda df, c: Counter({r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(c).alias("n")).collect() if r["n"]})
    again = mixing.repetitions(mixed)
    assert of(again, "words") == of(mixed, "taken")
    assert again.filter("words < 1 or repetition > 2").count() == 0
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mix(docs.filter("doc_id in (100, 101, 102)")).filter("taken > 0 or target > 0").count() == 0
    with pytest.raises(ValueError, match="sources"):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(mixing, "SOURCES", 2)
            mixing.mix(docs)


# Divergence of sources


def audit(docs, least, ranks):
    """docs: (text, lang, source)."""
    docs = [tuple(x or "" for x in d) for d in docs]
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    terms = [TERM.findall(t.translate(low)) for t, _, _ in docs]
    rows = []
    for lang in {d[1] for d in docs}:
        seen, n = Counter(), defaultdict(Counter)
        for w, (_, l, s) in zip(terms, docs, strict=True):  # noqa: E741
            if l == lang:
                seen.update(set(w))
                n[s].update(w)
        kept = [w for w, k in seen.items() if k >= least]
        p = {}
        for s in [*n, None]:
            count = n[s] if s is not None else sum(n.values(), Counter())
            total = sum(count[w] for w in kept)
            p[s] = {w: 1 + 10**9 * (count[w] + 5) // (total + 5 * len(kept)) for w in kept}
        for s in n:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in n if o != s]
            firsts = [(p[s][w] - p[None][w], w) for w in kept if n[s][w] and p[s][w] > p[None][w]]
            for part, found, most in (("pair", pairs, None), ("term", firsts, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                rows += [(lang, s, part, w, v, k + 1) for k, (v, w) in enumerate(found[:most])]
    return Counter(rows)


def audited(df):
    return Counter((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("block", "part"), [(divergence.BLOCK, divergence.PART), (7, 2)])
def test_divergence_of_odd_rows(docs, odd_rows, block, part):
    """Also in small blocks and parts of sources."""
    got = divergence.source_divergence(docs, least_docs=4, ranks=10, block=block, part=part)
    assert audited(got) == audit([(t, l, s) for _, t, l, s in odd_rows], 4, 10)  # noqa: E741


def test_divergence_of_scripts_and_bytes(spark, no_docs, monkeypatch):
    """Terms end at texts, digits and punctuation and not within a letter; only A-Z are lower-cased; one octet differs; stretches of one text."""
    monkeypatch.setattr(divergence, "STRETCH", 64)
    rng = random.Random(5)
    bits = ["a", "A", "B", "z", "Z", "é", "É", "ß", "中", "文", "😀", "\x00", "@", "[", "`", "{", "\x7f", "\x80", " ", "\n", "0", "ab" * 40]
    docs = [("".join(rng.choice(bits) for _ in range(rng.randrange(0, 90))), rng.choice(["x", "y", None, ""]), rng.choice(["s", "t", "é", "z", None])) for _ in range(300)]
    docs += [(None, "only", "a"), (None, "only", "b"), ("", "one", None), ("end", "x", "s"), ("ing", "x", "s")]
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumn("term", F.lit("own")).withColumn("n", F.lit(1))
    assert audited(divergence.source_divergence(df, least_docs=3, ranks=5, block=40)) == audit(docs, 3, 5)
    assert divergence.source_divergence(no_docs).count() == 0


def test_spellings_under_one_hash():
    """A hash that all slices share, or that lengths share, parts nothing that the octets do not."""
    raw = np.frombuffer("to be or not to be that is a question or an answer to it".encode(), np.uint8)
    low, start, end = divergence.slices(raw, np.array([0]))
    words = [low[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    for digest in (lambda x: 1, lambda x: len(x), hash):
        group, first = divergence.spellings(low, start, end, lambda x, d=digest: d(bytes(x)) & 0xFFFF)
        assert [words[first[g]] for g in group] == words
        assert len(set(group.tolist())) == len(set(words))


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(500):
        total, terms = rng.randrange(0, 10**15), rng.randrange(1, 10**7)
        n = rng.randrange(0, total + 1)
        assert int(divergence.shares(np.array([n]), total, terms)[0]) == 1 + 10**9 * (n + 5) // (total + 5 * terms)


# Hard negatives


def mined(rows, anchor=lambda k: k % 100 == 0, positives=5, negatives=5):
    """rows: (id, vector, label); a row's place tells rows of one id apart."""
    sound = [(k, np.floor(np.array(v, float) * 256).astype(object), y) for k, v, y in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, (k, v, y) in enumerate(sound):
        if k is None or not anchor(k):
            continue
        scored = [(int(sum(v * u)), j, z == y) for n, (j, u, z) in enumerate(sound) if n != i and len(u) == len(v)]
        for ps, p, _ in sorted((x for x in scored if x[2]), key=key)[:positives]:
            good = sorted((x for x in scored if not x[2] and 80 * ps <= 100 * x[0] <= 100 * ps), key=key)[:negatives]
            out += [(k, p, r + 1, n, ps, s) for r, (s, n, _) in enumerate(good)]
    return Counter(out)


def vectors(n, dim=8, seed=1, centres=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [(k, (middle[k % centres] + 0.4 * rng.normal(size=dim)).astype("float32").tolist(), int(rng.integers(3))) for k in range(n)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def negatives(df, every=10, **more):
    return Counter(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % every == 0, **more).collect()))


@pytest.mark.parametrize("gather", [hard_negatives.GATHER, 5])
def test_hard_negatives(spark, monkeypatch, gather):
    monkeypatch.setattr(hard_negatives, "GATHER", gather)
    monkeypatch.setattr(hard_negatives, "DIGIT", 4)
    rows = vectors(400)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("own")).withColumn("dim", F.lit(1))
    want = mined(rows, lambda k: k % 10 == 0)
    assert len(want) > 300
    assert negatives(df) == want
    assert negatives(df, wave_size=80) == want


def test_hard_negatives_of_copies(spark, monkeypatch):
    """Groups of equal vectors, with ids of their own and with one id, are parted by ids and places."""
    monkeypatch.setattr(hard_negatives, "GATHER", 5)
    monkeypatch.setattr(hard_negatives, "DIGIT", 3)
    rows = vectors(60)
    rows += [(1000 + 7 * k, rows[0][1], k % 2) for k in range(150)] + [(2**62 - 3 * k, rows[1][1], 1) for k in range(40)]
    rows += [(5, rows[2][1], k % 3) for k in range(60)] + [(None, rows[3][1], k % 2) for k in range(40)] + [(-20, rows[0][1], 0)] * 3
    assert negatives(spark.createDataFrame(rows, SCHEMA)) == mined(rows, lambda k: k % 10 == 0)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(80) + [(90, None, 1), (100, [0.5] * 8, None), (110, [nan] + [0.5] * 7, 1), (120, [inf] + [0.1] * 7, 0), (130, [None] + [0.1] * 7, 0), (140, [0.0] * 8, 2), (150, [], 1), (151, [], 1), (152, [], 0)]
    rows += [(160, [0.5, 0.25], 1), (161, [0.5, 0.5], 1), (162, [0.5, 0.3], 0), (163, [0.4, 0.3], 2), (-10, [-1.0, -1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert negatives(df) == mined(rows, lambda k: k % 10 == 0)
    assert negatives(df.limit(0)) == Counter()
    assert negatives(df.filter("vec_id % 10 <> 0")) == Counter()


@pytest.mark.parametrize("scale", [1.0, 5e3, 5e4])
def test_scores_are_exact(spark, scale):
    """Components whose products need single precision, double precision and 64-bit integers."""
    rows = [(k, [float(np.float32(x * scale)) for x in v], y) for k, v, y in vectors(120)]
    assert negatives(spark.createDataFrame(rows, SCHEMA)) == mined(rows, lambda k: k % 10 == 0)


def test_scores_beyond_64_bits(spark):
    rows = [(k, [1e9, float(k)], k % 2) for k in range(20)]
    with pytest.raises(OverflowError, match="64 bits"):
        negatives(spark.createDataFrame(rows, SCHEMA))
