"""The pipeline against brute force, the queries' columns, and the SQL of those that have some."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_filters import base, common_lines, components, contaminated, fingerprint  # noqa: F401
from test_tokens import check_packing

from plenum.llm import quality
from plenum.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op2_kd_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op4_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op7_simhash": ["doc_id", "fingerprint", "component_id"],
    "op8_token_counts": ["n_tokens", "n_docs", "docs_le", "docs_ge", "tokens_ge", "truncated_tokens"],
    "op9_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op11_source_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op12_source_divergence": ["lang", "source", "part", "item", "value", "rank"],
    "op13_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert set(COLUMNS[name]) <= set(df.columns)
    if name not in ("op8_token_counts", "op10_best_fit_packing", "op12_source_divergence", "op13_hard_negatives"):
        assert df.count() == spark.read.parquet(f"{sf_dir}/{'pages' if 'html' in name else 'documents'}.parquet").count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    want = con.sql(ORACLES[name])
    assert Counter(tuple(r) for r in df.select(*want.columns).collect()) == Counter(want.fetchall())


def test_sql_of_hashes():
    """XXH64 and CRC-32 in SQL against their libraries, for texts of every length of step."""
    import zlib

    import xxhash

    from plenum.llm import oracles

    texts = ["".join(chr(97 + (7 * k + j) % 26) if j % 9 else "é" for j in range(k)) for k in [*range(0, 45), 63, 64, 65, 200]]
    con = duckdb.connect()
    con.execute("CREATE TABLE u (s VARCHAR)")
    con.executemany("INSERT INTO u VALUES (?)", [(t,) for t in texts])
    got = dict(con.sql(f"WITH {oracles._xxh64(42)} SELECT * FROM z").fetchall())
    assert got == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}
    got = dict(con.sql(f"SELECT s, {oracles._crc32('encode(s)')} FROM u").fetchall())
    assert got == {t: zlib.crc32(t.encode()) for t in texts}


def test_simhash_sql_on_odd_rows(spark, docs):
    """Nulls, empty and long texts, repeated rows and ids."""
    from plenum.llm import simhash

    rows = docs.filter("length(text) < 3000 or text is null").select("doc_id", "text")
    con = duckdb.connect()
    con.register("documents", rows.toPandas())
    got = simhash.near_duplicates(rows).collect()
    assert Counter(map(tuple, got)) == Counter(con.sql(ORACLES["op7_simhash"]).fetchall())


def test_quality_sql_on_depleted_documents(spark, common_lines):
    """Where lines above the limits take most of a document, the SQL rejects what the operator rejects."""
    lines = [" ".join(f"w{k}x{n}" for n in range(10)) for k in "abcdefgh"]
    more = [(500 + k, "\n".join([*lines, f"own words of {k}"]), "h" if k % 2 else None) for k in range(60)]
    common_lines = common_lines.unionByName(spark.createDataFrame(more, common_lines.schema))
    rows = common_lines.collect()
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [tuple(r) for r in rows])
    want = con.sql(ORACLES["op4_quality_rules"])
    got = quality.quality_rules(common_lines)
    assert Counter(tuple(r) for r in got.select(*want.columns).collect()) == Counter(want.fetchall())
    assert got.filter("not base_failed and not kept").count() == 60


def lines_removed(docs):
    """Texts without the lines above the limits; None for documents that go. docs: (id, text, source)."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    norm = lambda x: re.sub(" +", " ", re.sub(r"[\t\v\f\r]", " ", re.sub("[1-9]", "0", x.lower()))).strip(" \t\n\v\f\r")
    seen = defaultdict(set)
    for _, t, s in docs:
        for x in (t or "").split("\n"):
            seen[(s, norm(x))].add(t)
    out = {}
    for k, t, s in docs:
        frequent = lambda x, s=s: bool(norm(x)) and len(seen[(s, norm(x))]) > quality.LINE_DOCS
        lines = (t or "").split("\n")
        gone = sum(len(word.findall(x)) for x in lines if frequent(x))
        n = len(word.findall(t or ""))
        if not base(t)[1] and n - gone >= quality.KEEP_SHARE * n:
            out[k] = "\n".join(x for x in lines if not frequent(x)) if gone else t
    return out


def test_pipeline(spark, sf_dir, tmp_path, monkeypatch):
    """On the smallest documents and more with a common line."""
    import corpus_pipeline

    monkeypatch.setattr(quality, "LINE_DOCS", 5)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.filter("doc_id < 40").selectExpr("doc_id + 100000 as doc_id", "concat('Common line number ', doc_id % 9, '\\n', text) as text", "lang", "'hot' as source", "n_chars")
    odd = spark.createDataFrame([(500000, None, None, None, 0), (500001, "12 !!", "en", "hot", 5), (None, "no id " * 60, "en", "hot", 9)], docs.schema)
    docs.unionByName(more).unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    kept = lines_removed([r for r in rows if r[1] and any(c.isalpha() for c in r[1])])
    assert any(kept.get(k) not in (None, t) for k, t, _ in rows)  # some texts lose a line
    first = components({k: fingerprint(t) for k, t in kept.items()})
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    final = {k: t for k, t in kept.items() if first[k] == k and not contaminated(t, bench)[4]}
    from plenum.llm.tokenizing import default_path, encoder

    want, total = Counter(), 0
    import zlib

    for k, t in final.items():
        ids = np.concatenate([np.frombuffer(encoder(default_path()).ids(t), "<u4"), np.array([1], "<u4")])
        total += len(ids)
        for p, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[(k, p, at, len(own), zlib.crc32(own.tobytes()))] += 1
    assert check_packing(got, want, 4096) <= -(-total // 4096) + 1
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


def run_on(spark, path, docs):
    import corpus_pipeline

    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "some benchmark item of a few words")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(path))


def test_pipeline_of_nothing(spark, no_docs, tmp_path):
    assert run_on(spark, tmp_path, no_docs).count() == 0


def test_pipeline_of_odd_rows(spark, docs, odd_rows, tmp_path):
    """Very long texts, repeated rows and ids, columns of clashing names: each text that passes the rules is packed once."""
    names = ["_lang", "_hit", "_id", "_host", "found", "none", "id", "text_hash", "one", "two"]
    more = docs.filter("doc_id < 20").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat(F.lit("Another one entirely. "), F.reverse("text")))
    df = docs.unionByName(more).select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    got = run_on(spark, tmp_path, df).filter("piece = 0")
    texts = [(k, t) for k, t, _, _ in odd_rows] + [(None, r["text"]) for r in more.collect()]
    good = {(k, t) for k, t in texts if t and any(c.isalpha() for c in t) and not base(t)[1]}
    fp = {t: fingerprint(t) for _, t in good}
    root = components({n: f for n, f in enumerate(sorted(set(fp.values())))})
    assert got.count() == len(set(root.values()))
    assert {r["doc_id"] for r in got.collect()} <= {k for k, _ in good}


def test_stages_keep_columns_of_any_name(spark, docs, tmp_path):
    import corpus_pipeline

    df = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in ("_lang", "_hit", "found", "none", "text_hash")])
    spark.createDataFrame([(1, "no such item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        assert {tuple(r) for r in out.select("_lang", "_hit", "found", "none", "text_hash").distinct().collect()} == {("own _lang", "own _hit", "own found", "own none", "own text_hash")}


def test_rows_without_ids_leave_large_ids_whole(spark):
    """Ids beyond 2**53 next to missing ones."""
    from plenum.llm import decontaminate, html_extract, packing, sharding, simhash, token_files
    from plenum.storage import scratch

    big = [2**60 + 1, 2**60 + 3, None, -(2**60) - 1]
    docs = spark.createDataFrame([(k, f"text of number {n}") for n, k in enumerate(big)], "doc_id long, text string").coalesce(1)
    of = lambda df, c="doc_id": Counter(r[c] for r in df.collect())
    path = scratch(spark, "test")
    token_files.write_token_files(docs, path)
    assert of(token_files.read_token_files(spark, path)) == of(packing.best_fit_packing(docs)) == of(simhash.near_duplicates(docs)) == Counter(big)
    assert of(sharding.shard_to_target(docs.selectExpr("*", "'en' as lang", "null as source"), shards=8)) == of(quality.quality_rules(docs.selectExpr("*", "null as source"))) == Counter(big)
    assert of(html_extract.extract(docs.selectExpr("doc_id as page_id", "'u' as url", "text as html")), "page_id") == Counter(big)
    assert of(decontaminate.contamination(docs, spark.createDataFrame([(None, "a"), (1, None)], "item_id long, text string"))) == Counter(big)
