"""Token counts, token files and packing against plain encoding."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plenum.llm import packing, token_counts, token_files
from plenum.llm.tokenizing import default_path, encoder
from plenum.storage import scratch


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcDEF 's'll.,!\n\t\x1c\x85 İΣςé<|>0123")), max_size=60))
def test_words_have_the_ids_of_the_library(text):
    from tokenizers import Tokenizer

    e = encoder(default_path())
    if not hasattr(test_words_have_the_ids_of_the_library, "t"):
        test_words_have_the_ids_of_the_library.t = Tokenizer.from_file(default_path())
    assert np.frombuffer(e.ids(text), "<u4").tolist() == test_words_have_the_ids_of_the_library.t.encode(text, add_special_tokens=False).ids


def test_full_caches_keep_the_ids(plain, monkeypatch):
    from plenum.llm import tokenizing

    monkeypatch.setattr(tokenizing, "CACHE_WORDS", 8)
    e = tokenizing.Encoder(default_path())
    for text in ["one two three four five six seven", "seven six one nine ten eleven", "one two three"] * 3:
        assert np.frombuffer(e.ids(text), "<u4").tolist() == plain(text)


def test_histogram(docs, odd_rows, no_docs, plain, monkeypatch):
    monkeypatch.setattr(token_counts, "SPAN", 16)
    lengths = [len(plain(t)) for _, t, _, _ in odd_rows]
    n = Counter(lengths)
    h = token_counts.length_histogram(token_counts.token_lengths(docs))
    got = {r["n_tokens"]: tuple(r)[1:] for r in h.collect()}
    assert got == {k: (c, sum(x <= k for x in lengths), sum(x >= k for x in lengths), sum(x for x in lengths if x >= k), sum(min(x, k) for x in lengths)) for k, c in n.items()}
    assert token_counts.truncated_total(h, 37).first()["tokens"] == sum(min(x, 37) for x in lengths)
    assert token_counts.length_quantile(h, 0.5).first()["n_tokens"] == sorted(lengths)[-(-len(lengths) // 2) - 1]
    empty = token_counts.length_histogram(token_counts.token_lengths(no_docs))
    assert empty.count() == 0 and token_counts.truncated_total(empty, 9).first()["tokens"] == 0 and token_counts.length_quantile(empty, 0.5).first()[0] is None


def test_histogram_agrees_with_sql(spark, sf_dir):
    """Suffix sums of the lengths of the smallest tables, by SQL over the lengths."""
    import duckdb

    lengths = token_counts.token_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas()
    con = duckdb.connect()
    con.register("lengths", lengths)
    want = con.sql(
        """WITH h AS (SELECT n_tokens, count(*) AS n_docs FROM lengths GROUP BY 1) SELECT n_tokens, n_docs, (SELECT count(*) FROM lengths l WHERE l.n_tokens <= h.n_tokens) AS docs_le, (SELECT count(*) FROM lengths l WHERE l.n_tokens >= h.n_tokens) AS docs_ge,
        (SELECT sum(l.n_tokens) FROM lengths l WHERE l.n_tokens >= h.n_tokens) AS tokens_ge, (SELECT sum(least(l.n_tokens, h.n_tokens)) FROM lengths l) AS truncated_tokens FROM h"""
    ).fetchall()
    got = token_counts.length_histogram(spark.createDataFrame(lengths)).select("n_tokens", "n_docs", "docs_le", "docs_ge", "tokens_ge", "truncated_tokens").collect()
    assert Counter(map(tuple, got)) == Counter(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), min_size=1, max_size=600))
def test_elias_fano_round_trip(xs):
    xs = sorted(xs)
    if xs[-1] - xs[0] >= 2**63:
        xs = [x // 4 for x in xs]
    ef = token_files.EliasFano.from_bytes(token_files.EliasFano.of(xs).to_bytes())
    assert ef.select(np.arange(len(xs))).tolist() == xs and ef.select(np.arange(0, len(xs), 7)).tolist() == xs[::7]
    assert [int(ef.select([i])[0]) for i in range(0, len(xs), 41)] == xs[::41]


def test_select_reads_one_stretch_alone():
    """What lies beyond a directory entry's stretch plays no part."""
    xs = np.cumsum(np.random.default_rng(2).integers(0, 3000, 5000))
    ef = token_files.EliasFano.from_bytes(token_files.EliasFano.of(xs).to_bytes())
    high = ef.high.copy()
    first, last = int(ef.directory[3]) >> 3, (int(ef.directory[4]) >> 3) + 1
    high[:first], high[last:] = 255, 255
    ef.high = high
    assert ef.select(np.arange(3 * 256, 4 * 256)).tolist() == xs[3 * 256 : 4 * 256].tolist()
    with pytest.raises(IndexError):
        ef.select([5000])


def test_elias_fano_is_near_the_minimum():
    bounds = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(token_files.EliasFano.of(bounds).to_bytes()) * 8 / len(bounds) < 2 + np.log2(bounds[-1] / len(bounds)) + 1
    assert token_files.EliasFano.of([]).select([]).tolist() == []


def test_token_files(spark, docs, odd_rows, plain, monkeypatch):
    path = scratch(spark, "test")
    token_files.write_token_files(docs.filter("doc_id is not null"), path)
    got = sorted(tuple(r) for r in token_files.read_token_files(spark, path).collect())
    want, at = [], 0
    for k, t in sorted((k, t) for k, t, _, _ in [(k, t or "", a, b) for k, t, a, b in odd_rows]):
        ids = np.array([*plain(t), 2], "<u4")
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)


def test_token_files_of_nothing_and_of_rows_without_ids(spark, docs, no_docs):
    path = scratch(spark, "test")
    token_files.write_token_files(no_docs, path)
    assert token_files.read_token_files(spark, path).count() == 0
    token_files.write_token_files(spark.createDataFrame([(None, "a"), (3, "b"), (None, "c")], "doc_id long, text string"), path)
    got = {(r["doc_id"], r["start"]) for r in token_files.read_token_files(spark, path).collect()}
    assert {s for k, s in got if k is None} == {0, 2} and (3, 4) in got


def test_equal_ids_have_one_order_and_are_parted(spark):
    """However the rows come; one id and one row may be most of the table."""
    rows = [(5, f"text {n % 40}") for n in range(300)] + [(5, "the same")] * 300 + [(None, "none")] * 200
    out = []
    for parts, own in ((3, rows), (7, rows[::-1])):
        path = scratch(spark, "test")
        token_files.write_token_files(spark.createDataFrame(own, "doc_id long, text string").repartition(parts), path)
        out.append(sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, path).collect()), key=str))
        assert spark.read.parquet(path).select("part").distinct().count() > 2
    assert out[0] == out[1] and len(out[0]) == 800


def test_places_come_from_select(spark):
    path = scratch(spark, "test")
    texts = ["a b c", "", "d e", "f " * 700]
    token_files.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path)
    for b in spark.read.parquet(path).collect():
        bounds = token_files.EliasFano.from_bytes(bytes(b["bounds"]))
        at = [token_files.place(bounds, i) for i in range(b["n_docs"])]
        assert at[0][0] == 0 and at[-1][1] == b["n_ids"] and all(x[1] == y[0] for x, y in zip(at, at[1:], strict=False))


def check_packing(rows, want_pieces, size):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want_pieces
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= size
    return len(bins)


def test_packing(docs, odd_rows, plain, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 24)  # several groups and rounds
    want, total = Counter(), 0
    for k, t, _, _ in odd_rows:
        ids = np.array([*plain(t), 1], "<u4")
        total += len(ids)
        for p, at in enumerate(range(0, len(ids), 512)):
            own = ids[at : at + 512]
            want[(k, p, at, len(own), zlib.crc32(own.tobytes()))] += 1
    n = check_packing(packing.best_fit_packing(docs, size=512).collect(), want, 512)
    assert n <= -(-total // 512) + 2


def test_packing_of_nothing(no_docs):
    assert packing.best_fit_packing(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=80))
def test_local_search_keeps_all_and_never_adds_bins(ns):
    lengths = np.array(ns)
    # Next fit leaves the bins that the search has to empty.
    first, fill = [[]], 0
    for i, n in enumerate(ns):
        if fill + n > 100:
            first.append([])
            fill = 0
        first[-1].append(i)
        fill += n
    after = packing.local_search(first, lengths, 100)
    assert sorted(i for b in after for i in b) == list(range(len(ns)))
    assert all(lengths[b].sum() <= 100 for b in after) and len(after) <= len(first)


def test_local_search_exchanges():
    """Sizes at which no piece can move, but exchanges empty a bin."""
    lengths = np.array([6, 3, 5, 4, 2])  # bins of 10: {6,3} {5,4} {2}
    assert len(packing.local_search([[0, 1], [2, 3], [4]], lengths, 10)) == 2


def test_local_search_goes_on_until_no_pair_of_bins_has_a_step():
    """Pieces of about a third of a bin, for which 2,000 pairs are not enough."""
    lengths = np.random.default_rng(1).integers(1100, 1700, 600)
    first = packing.best_fit(lengths, 4096)
    after = packing.local_search([b[:] for b in first], lengths, 4096)
    assert sorted(i for b in after for i in b) == list(range(600)) and max(lengths[b].sum() for b in after) <= 4096
    assert len(after) <= len(first) - 5
    fill = [int(lengths[b].sum()) for b in after]
    own = [sorted((int(lengths[i]), i) for i in b) for b in after]
    assert not any(packing._step(own[a], own[b], 4096 - fill[b]) for a in range(len(own)) for b in range(len(own)) if a != b and fill[a] <= fill[b] < 4096)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=0, max_size=9))
def test_least_bins_is_a_bound(ns):
    """Against the fewest bins of all ways to pack."""
    def fewest(rest, room):
        if not rest:
            return len(room)
        n, out = rest[0], 99
        for r in {r for r in room if r >= n}:
            other = list(room)
            other.remove(r)
            out = min(out, fewest(rest[1:], [*other, r - n]))
        return min(out, fewest(rest[1:], [*room, 20 - n]) if len(room) < 9 else 99)

    bound = packing.least_bins(np.array(ns, np.int64), 20)
    assert -(-sum(ns) // 20) <= bound <= fewest(sorted(ns, reverse=True), [])


def piece_rows(spark, lengths):
    rows = [(k, False, 0, 0, int(n), 0) for k, n in enumerate(lengths)]
    return spark.createDataFrame(rows, packing.PIECE)


def groups_of_at_most(monkeypatch, most):
    """Packing that fails where a task gets a larger group."""
    plain = packing._packer

    def packer(size):
        packed = plain(size)

        def checked(frame):
            assert len(frame) <= most
            return packed(frame)

        return checked

    monkeypatch.setattr(packing, "_packer", packer)


def sequences(out):
    return out.select("sequence_id").distinct().count()


def test_open_bins_are_packed_again_in_bounded_groups(spark, monkeypatch):
    """Pieces of which no four fill a bin: nearly all stay open after a round."""
    monkeypatch.setattr(packing, "GROUP", 128)
    groups_of_at_most(monkeypatch, 256)
    lengths = np.random.default_rng(3).integers(900, 1400, 3000)
    n = sequences(packing.pack(piece_rows(spark, lengths)))
    assert -(-int(lengths.sum()) // 4096) <= n < 0.97 * len(packing.best_fit(lengths, 4096))


def test_pieces_over_half_a_bin_stay_alone_in_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 128)
    groups_of_at_most(monkeypatch, 256)
    assert sequences(packing.pack(piece_rows(spark, [2100] * 3000))) == 3000


def test_equal_rows_are_dealt_apart(spark, monkeypatch):
    """One row many times."""
    monkeypatch.setattr(packing, "GROUP", 64)
    groups_of_at_most(monkeypatch, 128)
    rows = spark.createDataFrame([(7, False, 0, 0, 100, 0)] * 2000, packing.PIECE)
    out = packing.pack(rows, 400)
    assert out.count() == 2000 and sequences(out) == 500
