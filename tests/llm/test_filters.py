"""Language, quality, decontamination and near-duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plenum.llm import decontaminate, language_id, quality, simhash

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_languages(docs, odd_rows, no_docs):
    train, held = language_id.training_rows(docs)
    model = language_id.fit(train)
    out = docs.select("doc_id", "lang", held.alias("h"), language_id.identify(docs, model).alias("p")).select("doc_id", "lang", "h", "p.*").collect()
    assert len(out) == len(odd_rows)
    right = [r["lang_pred"] == r["lang"] for r in out if 0 <= r["doc_id"] < 60 and r["h"]]
    assert len(right) > 5 and sum(right) / len(right) > 0.9
    by_id = {r["doc_id"]: r for r in out}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (100, 101, 102, 103))
    assert all(0 <= r["score"] <= 1 for r in out)
    none = language_id.fit(language_id.training_rows(no_docs)[0])
    assert {r[0] for r in docs.select(language_id.identify(docs, none)["lang_pred"]).collect()} == {"und"}


@pytest.mark.parametrize("ids", ["null", "one", "repeated"])
def test_languages_without_ids_and_with_one_for_all(spark, prose, ids):
    """No language is lost, and the sample keeps its bound, whatever the ids; copies of a row count once."""
    texts = [(prose(lang, 40, k), lang) for k in range(120) for lang in ("en", "fr", "de")] + [(prose("en", 40, 0), "en")] * 500 + [(None, "fr"), ("", "de")]
    of = {"null": lambda k: None, "one": lambda k: 9, "repeated": lambda k: k % 7}[ids]
    train = spark.createDataFrame([(of(k), t, lang) for k, (t, lang) in enumerate(texts)], "id long, text string, lang string")
    for bound, most in ((50, 50), (1000, 120 if ids != "repeated" else 127)):
        model = language_id.fit(train, bound)
        assert model.languages == ["de", "en", "fr"]
        test = [(prose(lang, 30, 1000 + k), lang) for k in range(10) for lang in ("en", "fr", "de")]
        assert sum(p == lang for p, (_, lang) in zip(model.predict([t for t, _ in test])["lang_pred"], test, strict=True)) >= 28
        sizes = [r["n"] for r in language_id.sampled(train, bound).groupBy("lang").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 3 and max(sizes) <= most and min(sizes) >= min(bound, 120)


def test_code_lengths_are_those_of_the_trees(spark):
    """Against escapes followed one by one."""
    texts = {"x": "abracadabra abra", "y": "banana bandana"}
    grams = spark.createDataFrame([(k, t) for k, t in texts.items()], "lang string, text string")
    import pandas as pd

    counts = pd.concat(list(language_id._grams([grams.toPandas()])))
    model = language_id.ContextTrees.of(counts.groupby(["lang", "gram"], as_index=False)["n"].sum())

    def bits(text: str, trained: str) -> float:
        seen = defaultdict(Counter)
        s = "\0\0\0" + trained
        for i in range(3, len(s)):
            for k in range(4):
                seen[s[i - k : i]][s[i]] += 1
        total, s = 0.0, "\0\0\0" + text
        for i in range(3, len(s)):
            for k in (3, 2, 1, 0, -1):
                if k < 0:
                    total += 8
                    break
                c = seen.get(s[i - k : i])
                if not c:
                    continue
                n, u = sum(c.values()), len(c)
                if c[s[i]]:
                    total -= np.log2(c[s[i]] / (n + u))
                    break
                total -= np.log2(u / (n + u))
        return total

    probe = ["abra banana", "zzz", "", "é ü a"]
    got = model.bits([language_id.prepared(p) for p in probe])
    for k, p in enumerate(probe[:3]):
        for j, lang in enumerate(model.languages):
            assert got[k, j] == pytest.approx(bits(p, texts[lang]), abs=1e-3)
    language_id_slice, language_id.SLICE = language_id.SLICE, 4
    try:
        assert np.allclose(model.bits([language_id.prepared(p) for p in probe]), got, atol=1e-3)
    finally:
        language_id.SLICE = language_id_slice


def test_rows_are_found_by_their_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**32, 5000, dtype=np.uint32))
    rows = language_id.Rows(keys)
    assert rows.find(keys).tolist() == list(range(len(keys)))
    other = np.setdiff1d(rng.integers(0, 2**32, 5000, dtype=np.uint32), keys)
    assert (rows.find(other) == -1).all() and len(rows.find(keys[:0])) == 0
    assert language_id.Rows(keys[:0]).find(keys[:3]).tolist() == [-1] * 3


def test_room_grows_with_the_sample_and_not_with_the_alphabet(spark):
    """Forty languages, each of its own script, whose table over all bytes and contexts would not fit."""
    rng = random.Random(3)
    texts = {f"l{k:02}": "".join(chr(0x4E00 + 97 * k + rng.randrange(60)) + " " * (rng.random() < 0.2) for _ in range(800)) for k in range(40)}
    model = language_id.fit(spark.createDataFrame([(n, t, k) for n, (k, t) in enumerate(texts.items())], "id long, text string, lang string"))
    assert model.predict([t[100:160] for t in texts.values()])["lang_pred"].tolist() == list(texts)
    assert sum(x.nbytes for x in (*model.cost, *model.escape)) < 64 << 20


def base(text):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    t = text or ""
    w = word.findall(t)
    triples = list(zip(w, w[1:], w[2:]))  # noqa: B905
    n = Counter(triples)
    covered = {i + d for i, x in enumerate(triples) if n[x] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if word.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(docs, odd_rows, no_docs):
    got = quality.quality_rules(docs).collect()
    assert Counter((r["doc_id"], tuple(r)[1:6], r["base_failed"]) for r in got) == Counter((k, *base(t)) for k, t, _, _ in odd_rows)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # no line is above the limits here
    assert quality.quality_rules(no_docs).count() == 0


@pytest.fixture(scope="module")
def common_lines(spark):
    """40 texts of one host that share a line; 3 of them are little else; 40 copies of one text."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    own = lambda n: "\n".join(" ".join(word() for _ in range(10)) for _ in range(n))
    shared = "Shared LINE number 7 of this host"
    rows = [(k, own(8) + "\n" + shared, "h") for k in range(40)]
    rows += [(100 + k, "\n".join([shared] + ["shared  line number 3 of this host"] * 9) + "\n" + own(2).replace("\n", f"\n{k} "), "h") for k in range(3)]
    copy = own(12)
    rows += [(200 + k, copy, "h") for k in range(40)] + [(300, own(8) + "\n" + shared, "other"), (301, own(8), None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_frequent_lines_go_and_depleted_documents_too(common_lines):
    got = {r["doc_id"]: r for r in quality.quality_rules(common_lines).collect()}
    assert all(got[k]["n_removed_words"] == 7 and got[k]["kept"] for k in range(40))
    assert all(got[k]["n_removed_words"] == 70 and not got[k]["kept"] for k in (100, 101, 102))
    assert all(got[k]["n_removed_words"] == 0 and got[k]["kept"] for k in [*range(200, 240), 300, 301])


def test_copies_count_where_asked(common_lines):
    """By document ids, a text that a host has 40 times has frequent lines alone."""
    got = {r["doc_id"]: r for r in quality.quality_rules(common_lines, copies=True).collect()}
    assert all(got[k]["n_removed_words"] == got[k]["n_words"] and not got[k]["kept"] for k in range(200, 240))
    assert all(got[k]["n_removed_words"] == 7 and got[k]["kept"] for k in range(40))
    twice = common_lines.filter("doc_id >= 200").withColumn("doc_id", F.lit(1).cast("long"))
    assert quality.quality_rules(twice, copies=True).filter("n_removed_words > 0").count() == 0  # one id is one document


def test_clashing_columns_stay(common_lines, no_docs):
    names = ["_id", "id", "host", "hash", "gone", "lines", "_row", "n_words", "kept", "_gone", "line"]
    df = common_lines.select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    out = quality.clean(df)
    assert out.columns == df.columns and out.count() == quality.clean(common_lines).count()
    assert out.select(*names).distinct().collect() == df.select(*names).distinct().collect()
    assert quality.quality_rules(df).count() == df.count() and quality.clean(no_docs).count() == 0


def test_odd_white_space_and_one_very_long_line(spark):
    texts = ["\x0b\x0c a\t\tb\r\nc  d\x0b\ne\x85f \u00a0 g", " \n \t", "Ab1\t2\nab9  9", "word " * 200_000, "x\n" * 5000, "ΟΔΟΣ\nΟΔΟΣ σ", "a b c a b c", None]
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality.quality_rules(df).collect()}
    for k, t in enumerate(texts):
        assert (tuple(got[k])[1:6], got[k]["base_failed"]) == base(t)


def test_clean_takes_the_lines_out(common_lines):
    rows = {r["doc_id"]: r["text"] for r in common_lines.collect()}
    out = {r["doc_id"]: r["text"] for r in quality.clean(common_lines).collect()}
    assert set(out) == set(rows) - {100, 101, 102}
    assert out[0] == rows[0].rsplit("\n", 1)[0] and out[300] == rows[300] and out[200] == rows[200]


def test_long_lines_count_as_short_ones_do(spark):
    """A passage of 60 words on one line of 30 documents goes; documents of little else are depleted."""
    rng = random.Random(8)
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared = own(60)
    rows = [(k, own(80) + "\n" + shared, "h") for k in range(25)] + [(100 + k, own(20) + "\n" + shared, "h") for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_removed_words"], r["kept"]) for r in quality.quality_rules(df).collect()}
    assert got == {k: (60, k < 100) for k, _, _ in rows}
    out = {r["doc_id"]: r["text"] for r in quality.clean(df).collect()}
    assert out == {k: t.split("\n")[0] for k, t, _ in rows if k < 100}


def test_a_large_host_hides_no_line(spark):
    """A line of 25 among 1,500 documents of a host goes as it does among 25."""
    rng = random.Random(9)
    own = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    rows = [(k, own() + ("\nOne line of a few" if k < 25 else ""), "large") for k in range(1500)] + [(2000 + k, own() + "\nOne line of a few", "small") for k in range(25)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"] for r in got if r["n_removed_words"] == 5} == {*range(25), *range(2000, 2025)}


def contaminated(text, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        i = word.findall((t or "").translate(LOWER))
        for at in range(max(1, len(i) - size + 1) if i and item is not None else 0):
            x = i[at : at + size]
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit.update(range(p, p + len(x)))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


def test_contamination(spark, docs, odd_rows, no_docs, monkeypatch):
    text = odd_rows[9][1].split()
    items = [(1, " ".join(text[3:25]).upper()), (22, " ".join(text[20:34])), (3, None), (4, "..."), (None, " ".join(text[:12])), (5, "x, Y z"), (5, "été MÊME"), (6, " ".join(odd_rows[0][1].split()[:9]))]
    items += [(10, "z x y z x y z x y z x"), (1, " ".join(text[3:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 15):  # one block, and several
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        df = decontaminate.contamination(docs.withColumn("found", F.lit(1)), bench, "c")
        assert df.columns == [*docs.columns, "found", "c"]
        rows = df.select("doc_id", "text", "c").collect()
        assert Counter((r["doc_id"], r["c"]["n_words"], r["c"]["n_hit"], r["c"]["n_items"], r["c"]["items_sha256"], r["c"]["contaminated"]) for r in rows) == Counter((k, *contaminated(t, items)) for k, t, _, _ in odd_rows)
        assert decontaminate.contamination(no_docs, bench).count() == 0
        assert not decontaminate.contamination(docs, bench.limit(0)).filter("contamination.contaminated").count()
    named = bench.withColumn("item_id", F.concat(F.lit("item-"), F.col("item_id")))
    assert {r[0] for r in decontaminate.contamination(docs, named, "c").filter("c.contaminated").select(F.explode("c.items")).distinct().collect()} <= {f"item-{k}" for k in (1, 22, 5, 6, 10)}


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(fp: dict[int, int]) -> dict[int, int]:
    keys, root = sorted(fp), {k: k for k in fp}
    bits = np.array([fp[k] for k in keys], np.uint64)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 3):
            a, b = top(k), top(keys[j])
            root[max(a, b)] = min(a, b)
    return {k: top(k) for k in keys}


def test_near_duplicates(docs, odd_rows, no_docs):
    fp = {k: fingerprint(t) for k, t, _, _ in odd_rows}
    want = components(fp)
    got = simhash.near_duplicates(docs).collect()
    assert Counter(tuple(r) for r in got) == Counter((k, "%016x" % fp[k], want[k]) for k, _, _, _ in odd_rows)
    assert want[105] == want[5] == 5 and want[100] == want[101]
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("place", [simhash.PLACE, 32])
def test_links_connect_what_is_connected(spark, monkeypatch, place):
    """Balls and chains around a few centres; small places are dealt into parts."""
    from plenum.operators.components import connected_components

    monkeypatch.setattr(simhash, "PLACE", place)
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(3):
        c = x = rng.getrandbits(64)
        for _ in range(150):
            y = c
            for b in rng.sample(range(64), rng.choice((1, 2, 3, 5))):
                y ^= 1 << b
            fps.add(y)
        for _ in range(20):
            x ^= sum(1 << b for b in rng.sample(range(64), 3))
            fps.add(x)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = components({k: k % 2**64 for k in signed})
    df = spark.createDataFrame([(k,) for k in signed], "fp long")
    got = {r["node"]: r["component"] for r in connected_components(simhash.links(df)).collect()}
    assert {k: got.get(k, k) for k in signed} == want


def test_pivot_distances_bound_the_distance(spark):
    fps = [0, 1, -1, 12345678901234567, -(2**63)]
    t = simhash.pivot_table(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    cells = {r["fp"]: [int(x) for c in ("t0", "t1") for x in np.array([r[c]], np.int64).view(np.uint8)] for r in t}
    assert cells[0] == [bin(r % 2**64).count("1") for r in simhash.references()]
    for a in fps:
        for b in fps:
            assert max(abs(x - y) for x, y in zip(cells[a], cells[b], strict=True)) <= bin((a ^ b) % 2**64).count("1")


def test_pair_references_move_by_their_own_bits(spark):
    """near: two bits for each pair of bits, the number of its ones, from distances alone."""
    fps = [0, 1, -1, 12345678901234567, -(2**63), 3 << 20]
    got = {r["fp"]: r["near"] % 2**64 for r in simhash.pivot_table(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    for f, near in got.items():
        assert [near >> 2 * k & 3 for k in range(32)] == [bin(f % 2**64 >> 2 * k & 3).count("1") for k in range(32)]


@pytest.mark.parametrize("groups", [5, 6, 7, 8, 10])
def test_every_linked_pair_meets(spark, groups):
    rng = random.Random(groups)
    pairs = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), rng.choice((1, 2, 3))))
        pairs.append((a, b))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    table = simhash.pivot_table(spark.createDataFrame([(signed(f),) for p in pairs for f in p], "fp long"))
    met = defaultdict(set)
    for r in simhash.meeting_places(table, groups).collect():
        met[r["fp"]].add((r["choice"], r["bits"]))
    assert all(met[signed(a)] & met[signed(b)] for a, b in pairs)


def test_pair_report(spark):
    rng = random.Random(1)
    fps = [rng.getrandbits(63) for _ in range(400)] + [7, 6, 4, 0]
    r = simhash.pair_report(spark.createDataFrame([(f,) for f in fps], "fp long")).first()
    assert r["met"] >= r["left"] >= r["linked"] >= 6


def test_one_row_of_each_component_stays(spark):
    """Repeated and missing ids are documents of their own where their texts differ."""
    text = lambda k: " ".join(f"w{k}x{n}" for n in range(40))
    rows = [(1, text(1), "a"), (1, text(2), "b"), (None, text(3), "c"), (None, text(4), "d"), (5, text(4), "e"), (6, text(6), "f"), (6, text(6), "g"), (7, text(6), "h"), (None, None, "i"), (9, "", "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter([(1, text(1)), (1, text(2)), (None, text(3)), (5, text(4)), (6, text(6)), (9, "")])
    assert simhash.one_of_each(df.limit(0)).count() == 0
