"""Text functions, model stages and files."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from plenum.functions import predicates, text
from plenum.operators import annotate, identity
from plenum.sources import files


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_predicates(spark):
    assert one(spark, predicates.is_bot(F.col("a"), {"ci"}, ["[bot]", "-bot"]), a="vote[bot]") is True
    assert one(spark, predicates.is_bot(F.col("a"), {"ci"}, ["[bot]"]), a="x-bot") is False
    assert one(spark, predicates.is_bot(F.col("a"), {"ci"}, ["[bot]"]), a=None) is False
    assert one(spark, predicates.strip(F.col("a")), a="  x ") == "x"
    assert one(spark, predicates.long_enough(F.col("a")), a=" " * 30) is False
    assert one(spark, predicates.first_of(F.col("a"), F.col("b")), a="", b="z") == "z"


def test_marks_links_and_cells(spark):
    assert one(spark, text.strip_markdown(F.col("a")), a=" **b** *i* `c` ") == "b i c"
    assert one(spark, text.first_url(F.col("a")), a="see [x](https://a.b/c) https://d.e") == "https://a.b/c"
    assert one(spark, text.first_url(F.col("a")), a="(https://d.e/f)。") == "https://d.e/f"
    assert one(spark, text.clean_institution(F.col("a")), a="@**Org** (team)") == "Org"
    h = one(spark, text.handles(F.col("a")), a="**Ann-X** / @AnnX / -")
    assert (h["primary"], h["alts"]) == ("Ann-X", ["AnnX"])
    assert one(spark, text.clean_handle(F.col("a")), a="—") is None
    assert one(spark, text.first_pattern(F.col("a")), a="PhD at GOOGLE") == "Google"
    assert one(spark, text.quoted_numbers(F.col("a")), a='<aside data-post="3"> data-post="2" data-post="3"') == ["3", "2"]


def test_thread_keys(spark):
    u = F.col("u")
    assert one(spark, text.thread_key(F.lit(None), F.lit(None), [u]), u="https://x/repo/issues/12#c") == "issue_12"
    assert one(spark, text.thread_key(F.lit(7), F.lit(None), [u]), u="/issues/12") == "pr_7"
    assert one(spark, text.thread_key(F.lit(7), F.lit(None), [u], merge=True), u="") == "thread_7"


def test_html_quotes(spark):
    r = one(spark, text.html_text(F.col("h")), h='<p>a &amp; b</p><aside class="quote x"><p>q</p></aside><p>c</p>')
    assert (r["raw_text"], r["own_text"]) == ("a & b q c", "a & b c")


def test_answers_become_rows(spark):
    assert one(spark, text.clean_response(F.col("a")), a='<think>\nx</think>```json\n{"a":1}\n```') == '{"a":1}'
    ok = one(spark, text.parse_annotation(F.col("a")), a='{"stance": "Support"}')
    assert ok["annotation"]["stance"] == "Support" and ok["annotation_error"] is None
    assert one(spark, text.parse_annotation(F.col("a")), a="nothing")["annotation_error"].startswith("json_parse:")
    assert one(spark, text.parse_annotation(F.col("a"), F.col("b")), a=None, b="Timeout: x")["annotation_error"].startswith("api_error:")


def test_retry_gives_up_with_empty_answers():
    waits, calls = [], []

    def bad(texts):
        calls.append(1)
        raise OSError

    assert annotate.with_retry(bad, sleep=waits.append)(["a", "b"]) == ["", ""]
    assert len(calls) == 6 and waits == [1.0, 2.0, 4.0, 8.0, 16.0]


def test_stage_resumes_and_retries(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"text {i} good") for i in range(5)], "id string, t string")
    path = str(tmp_path / "stage")
    bad = annotate.run_stage(spark, rows.limit(3), "id", "t", path, lambda texts: ["?"] * len(texts))
    assert bad.filter("annotation_error is not null").count() == 3
    done = annotate.run_stage(spark, rows, "id", "t", path)
    assert done.count() == 5 and done.filter("annotation_error is null").count() == 5
    before = spark.read.parquet(path).count()
    annotate.run_stage(spark, rows, "id", "t", path)
    assert spark.read.parquet(path).count() == before


def test_files(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps([{"id": 1, "a": "x"}, {"id": "pr_2", "a": None}]))
    got = files.read_json_array(spark, str(p), "id string, a string").orderBy("_pos").collect()
    assert [(r["id"], r["a"], r["_pos"]) for r in got] == [("1", "x", 0), ("pr_2", None, 1)]
    assert files.read_json_array(spark, str(tmp_path / "none.json"), "id string").count() == 0
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"ann": {"found": True, "name": "Ann"}, "bob": {"found": False}}))
    assert {(r["handle"], r["found"], r["name"]) for r in files.read_json_map(spark, str(m), "found boolean, name string").collect()} == {("ann", True, "Ann"), ("bob", False, None)}
    df = spark.createDataFrame([("f", 'a,"b'), ("g", "x\ny")], "source string, t string")
    files.write_csv(df, str(tmp_path / "csv"))
    assert {tuple(r) for r in files.read_csv(spark, str(tmp_path / "csv")).collect()} == {tuple(r) for r in df.collect()}
    files.write_json(df, str(tmp_path / "js"))
    assert spark.read.json(str(tmp_path / "js")).count() == 2
    assert files.checksums(spark, str(p)).first()["bytes"] == p.stat().st_size
    assert files.merge_manifest(files.manifest(df), spark.createDataFrame([("f", 9)], "source string, n long")).count() == 2
    assert files.merge_new(df, spark.createDataFrame([("f", "1"), ("h", "2"), ("h", "3")], "source string, t string"), "source").count() == 3
    assert files.markdown_table(df.limit(1)).startswith("| source | t |")
    assert files.metric_table(spark.createDataFrame([("a", 1, 2.0), ("b", 3, 4.0)], "k string, m long, n double"), "k").count() == 2


def test_identity(spark):
    p = spark.createDataFrame([(0, "ann", "annx", None), (1, "bob", "annx", "bobf")], "pos long, canonical string, github string, forum string")
    a = identity.aliases(p, "canonical", ["canonical", "github", "forum"], "pos")
    assert {r["alias"]: r["canonical"] for r in a.collect()} == {"ann": "ann", "annx": "bob", "bob": "bob", "bobf": "bob"}
    rows = spark.createDataFrame([("annx",), ("zed",)], "author string")
    assert {r["canonical"] for r in identity.canonical(rows, "author", a).collect()} == {"bob", "zed"}
    e = spark.createDataFrame([(0, "Ann", "lm_inferred", "Confirmed"), (1, "ann", "manual_R07", "Probable"), (2, "ANN", "manual_R07", "Probable")], "pos long, h string, s string, c string")
    assert identity.best_entry(e, "h", "s", "c", "pos").first()["pos"] == 1


def test_themes_are_grouped_reviewed_and_assigned(spark):
    codes = spark.createDataFrame([("1", "b/x"), ("2", "a/y"), ("3", "a/z"), ("4", ""), ("5", None), ("6", "b/x")], "id string, code string")
    themes = annotate.aggregate(codes, "code", annotate.group_by_first_part)
    assert themes == {"a": ["a/y", "a/z"], "b": ["b/x"]}
    book = annotate.review(themes, annotate.keep_in_order)
    assert [(e["theme_id"], e["label"]) for e in book] == [("T01", "a"), ("T02", "b")]
    got = {r["record_id"]: (r["theme_id"], r["confidence"]) for r in annotate.assign(codes, "id", "code", annotate.themes_table(spark, book)).collect()}
    assert got == {"1": ("T02", "high"), "2": ("T01", "high"), "3": ("T01", "high"), "4": ("Unclassified", "low"), "5": ("Unclassified", "low"), "6": ("T02", "high")}
    no = lambda prompts: ["no json"] * len(prompts)
    assert annotate.aggregate(codes, "code", no) == {} and annotate.review(themes, no) == []
    assert annotate.review(themes, lambda p: ['[{"theme_id": "X", "label": "l"}, {"label": "m"}]']) == [{"theme_id": "X", "label": "l", "description": "", "codes": []}, {"theme_id": "T02", "label": "m", "description": "", "codes": []}]


def test_samples_of_strata(spark):
    rows = spark.createDataFrame([(k, "abc"[k % 3] if k < 90 else "d") for k in range(93)], "id long, s string")
    draw = lambda seed: sorted((r["s"], r["id"]) for r in annotate.stratified_sample(rows, "s", {"a": 5, "b": 100, "c": 1}, "id", seed).collect())
    got = draw(42)
    assert [s for s, _ in got].count("a") == 5 and [s for s, _ in got].count("b") == 30 and [s for s, _ in got].count("c") == 1 and len(got) == 36
    assert got == draw(42) != draw(7)


def test_lookup_over_handles(spark):
    p = spark.createDataFrame([("p", "ANN", "x", "bob"), ("q", "", None, "Bob"), ("r", None, "zed", None)], "key string, canonical string, code string, forum string")
    e = identity.best_entry(spark.createDataFrame([(0, "ann", "manual_R07", "Confirmed"), (1, "bob", "manual_R07", "Confirmed")], "pos long, h string, s string, c string"), "h", "s", "c", "pos")
    got = {r["key"]: (r["h"], r["found_by"]) for r in identity.lookup(p, "key", ["canonical", "code", "forum"], e).collect()}
    assert got == {"p": ("ann", 1), "q": ("bob", 3), "r": (None, None)}


def test_manual_sections(spark):
    md = "## A\n| h | n | i | c | e |\n|---|---|---|---|---|\n| @x / y | — | **Org** (a) | Strong | [t](https://a.b/c) end |\n| — | n | o | c | e |\n| short | row |\n## B\n| h | n | c | t |\n|-|-|-|-|\n| @u | U | 3 | |\n| v |\n## C\n| h | l | a | e |\n|-|-|-|-|\n| w | Google | (none) | why |"
    t = text.markdown_tables(spark.createDataFrame([("d", md)], "id string, t string"), "id", "t")
    got = {r["primary_handle"]: r for r in text.manual_entries(t, {"## A": ("confirmed", "one", "1"), "## B": ("unknown", "one", "2"), "## C": ("corrections", "two", "3")}).collect()}
    assert set(got) == {"x", "u", "v", "w"}
    assert (got["x"]["alt_handles"], got["x"]["display_name"], got["x"]["institution"], got["x"]["evidence"], got["x"]["evidence_url"]) == (["y"], None, "Org", "t end", "https://a.b/c")
    assert got["u"]["evidence"] == text.EMPTY_NOTES and got["v"]["evidence"] == text.NO_NOTES and got["w"]["institution"] == "Unknown" and got["w"]["lm_wrong"] == "Google"


def test_density_clusters(spark):
    """Against neighbours counted one by one."""
    import math
    import random

    from plenum.operators import topics

    rng = random.Random(2)
    unit = lambda a: [math.cos(a), math.sin(a), 0.1 * rng.random()]
    rows = [(k, unit(0.02 * k)) for k in range(12)] + [(20 + k, unit(2 + 0.02 * k)) for k in range(6)] + [(40, unit(4.0)), (41, unit(5.0)), (50, unit(0.27))] + [(60, None)]
    got = {r["id"]: r["topic"] for r in topics.density_cluster(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", eps=0.12, min_points=4).collect()}
    assert {got[k] for k in range(12)} == {0} and {got[20 + k] for k in range(6)} == {1} and got[40] == got[41] == -1 and 60 not in got
    assert topics.density_cluster(spark.createDataFrame([], "id long, v array<double>"), "id", "v", eps=0.1).count() == 0


def test_wrapped_labels(spark):
    rows = [("T1", "short"), ("T2", "one long label with & an ampersand in it"), ("T3", "another quite long label without that sign"), ("T4", "x" * 50)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string, l string").select(text.wrapped(F.col("h"), F.col("l"))).collect()]
    assert got == ["T1: short", "T2: one long label with &\nan ampersand in it", "T3: another quite long label\nwithout that sign", "T4: " + "x" * 50]


def test_long_reports_say_that_they_are_cut(spark):
    df = spark.range(5)
    assert files.markdown_table(df, 3).endswith("The first 3 rows.") and files.markdown_table(df, 3).count("\n| ") == 3 and "first" not in files.markdown_table(df, 5)


def test_coverage_by_source_and_error(spark):
    from plenum.operators import profiles

    raw = spark.createDataFrame([("a", "x", 0, "u", "d1"), ("b", "x", 1, "u", "d2"), ("c", "y", 2, "v", "d1"), ("d", "y", 3, "w", "d9")], "record_id string, source string, _pos long, author string, date string")
    done = raw.filter("_pos < 3").withColumn("annotation_error", F.when(F.col("_pos") == 1, "json_parse: {").when(F.col("_pos") == 2, "text_too_short"))
    got = {r["source"]: tuple(r)[1:] for r in profiles.coverage_by(raw, done, "source", "record_id", F.col("_pos") >= 0).collect()}
    assert got == {"x": (2, 2, 1, 1, 0, "WARN"), "y": (2, 2, 0, 1, 1, "FAIL")}
    assert {tuple(r) for r in profiles.error_summary(done, "source").collect()} == {("x", "ok", None, 1), ("x", "failed", "json_parse", 1), ("y", "short", None, 1)}
    assert {tuple(r) for r in profiles.coverage_by_author(raw, done, "source").collect()} == {("x", 2, 1, 1, 0), ("y", 2, 0, 1, 1)}


def test_embeddings_are_means_over_the_mask(spark):
    import numpy as np

    from plenum.operators import embed

    v = np.array([[[3.0, 4.0], [100.0, 100.0]], [[0.0, 0.0], [0.0, 0.0]]])
    assert embed.pooled(v, np.array([[1, 0], [0, 0]])).tolist() == [[0.6, 0.8], [0.0, 0.0]]
    texts = spark.createDataFrame([(1, "ab cde"), (2, None), (3, "x " * 500 + "eeee")], "id long, t string")
    got = {r["id"]: r["embedding"] for r in embed.embeddings(texts, "id", "t", batch=2).collect()}
    want = np.array([5, 1, 2]) / np.sqrt(30)
    assert np.allclose(got["1"], want) and got["2"] == [0.0, 0.0, 0.0] and got["3"][1] == 0.0  # only the first tokens count


def test_drawings(spark, tmp_path):
    from plenum.sources import drawings

    n = spark.createDataFrame([("a", "</script><b>"), ("b", None)], "id string, label string")
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    drawings.graph_page(spark, f"file://{tmp_path}/g.html", "T <1>", {"one": (n, e), "two": (n, e)}, {"x & y": "red"})
    page = (tmp_path / "g.html").read_text()
    assert page.count("<canvas") == 2 and "T &lt;1&gt;" in page and "x &amp; y" in page and page.count("</script>") == 2
    drawings.bar_figure(spark, f"file://{tmp_path}/b.svg", "B", spark.createDataFrame([("a", 2.0), ("b", 4.0), ("c", None)], "k string, v double"), "k", "v")
    svg = (tmp_path / "b.svg").read_text()
    assert 'width="200.00"' in svg and 'width="400.00"' in svg and svg.count("<rect") == 3
