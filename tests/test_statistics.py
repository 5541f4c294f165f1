"""Hand-solved cases and properties of the statistics."""

from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plenum.operators import association, inequality, timebins


def values(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "x double")


def test_gini(spark):
    from pyspark.sql import functions as F

    assert inequality.gini(values(spark, [1, 1, 1, 1]), "x").first()["gini"] == 0
    assert inequality.gini(values(spark, [4, 0, 0, 0]), "x").first()["gini"] == pytest.approx(0.75)
    assert inequality.gini(values(spark, [4]), "x", zeros=F.lit(3)).first()["gini"] == pytest.approx(0.75)
    assert inequality.gini(values(spark, [0, 0]), "x").first()["gini"] == 0


def test_chi_square_of_proportional_rows(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 20 + [("b", "y")] * 40
    r = association.chi_square(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    assert (r["chi2"], r["dof"], r["cramers_v"]) == (0.0, 1, 0.0)


def test_kappa(spark):
    k = association.cohen_kappa(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "a string, b string"), "a", "b").first()
    assert (k["p_o"], k["p_e"], k["kappa"]) == (0.75, 0.5, 0.5)
    assert association.cohen_kappa(spark.createDataFrame([("a", "a")] * 3, "a string, b string"), "a", "b").first()["kappa"] == 1.0


def test_confusion_over_free_text_is_refused(spark):
    rows = spark.range(1200).selectExpr("'a' || id as a", "'b' as b")
    with pytest.raises(ValueError):
        association.confusion_matrix(rows, "a", "b")


def test_divergence_of_disjoint_topics_is_ln_2(spark):
    t = inequality.divergence_table(spark.createDataFrame([("p", 5, 0), ("q", 0, 7)], "t string, a long, b long"), "t", "a", "b")
    assert t.first()["js_total"] == pytest.approx(math.log(2), abs=1e-6)


@pytest.mark.parametrize(("x", "dof", "p"), [(3.841, 1, 0.05), (5.991, 2, 0.05), (11.345, 3, 0.01), (13.277, 4, 0.01), (21.026, 12, 0.05)])
def test_chi2_tail(x, dof, p):
    assert association.chi2_tail(x, dof) == pytest.approx(p, abs=1e-4)


@settings(max_examples=50, deadline=None)
@given(st.floats(0, 200), st.integers(1, 30))
def test_chi2_tail_is_a_decreasing_probability(x, dof):
    assert 0 <= association.chi2_tail(x + 1, dof) <= association.chi2_tail(x, dof) <= 1


def test_elbow_and_bins(spark):
    counts = spark.createDataFrame([(i, 100 - i if i < 21 else 20 - i // 5) for i in range(25)], "actor long, n long")
    assert timebins.elbow_cutoff(counts, "n", "actor").first()["cutoff"] == 21
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", "x"), ("a", "2024-01-14 23:59:59", "y"), ("a", "2024-01-15 00:00:00", "x"), ("a", None, "x")], "k string, t string, c string")
    b = timebins.anchored_bins(rows.withColumn("t", timebins.parse_ts(rows["t"])), "k", "t", "c", 14).collect()
    assert {(r["bin"], r["c"], r["pct"]) for r in b} == {(0, "x", 50.0), (0, "y", 50.0), (1, "x", 100.0)}


def test_gini_in_ranges(spark):
    rows = spark.createDataFrame([(g, float((k * 37) % 101)) for g in "ab" for k in range(150 if g == "a" else 40)], "g string, x double")
    plain = {r["g"]: r["gini"] for r in inequality.gini(rows, "x", ["g"]).collect()}
    assert {r["g"]: r["gini"] for r in inequality.gini(rows, "x", ["g"], ranges=True).collect()} == pytest.approx(plain)
    assert inequality.gini(rows, "x", ranges=True).first()["gini"] == pytest.approx(inequality.gini(rows, "x").first()["gini"])


def test_chi_test(spark):
    """Values of a table with one degree of freedom, corrected, and of one with an empty row and an unknown category."""
    cells = lambda t: spark.createDataFrame([(r, c) for (r, c), n in t.items() for _ in range(n)], "r string, c string")
    r = association.chi_test(cells({("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 20, ("b", "y"): 5}), "r", "c", ["x", "y"]).first()
    assert (r["chi2"], r["dof"], r["n"], r["cramers_v"], r["stars"], r["effect"]) == (10.17, 1, 55, 0.43, "**", "medium") and r["p_value"] == pytest.approx(math.erfc(math.sqrt(10.17 / 2)), abs=2e-6)
    even = association.chi_test(cells({("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 20, ("b", "y"): 40}), "r", "c", ["x", "y"]).first()
    assert (even["chi2"], even["p_value"], even["interpretation"]) == (0.0, 1.0, "not significant")
    more = association.chi_test(cells({("a", "x"): 8, ("a", "y"): 2, ("b", "x"): 1, ("b", "y"): 9, ("c", "other"): 30}), "r", "c", ["x", "y", "z"]).first()
    assert (more["n"], more["dof"]) == (20, 1)  # the row without known categories and the column without rows are left out


def test_mean_kappa(spark):
    p = spark.createDataFrame([("a", "a", "x", "x"), ("a", "b", "y", "y"), ("b", "b", "x", "x"), ("b", "b", "y", "y")], "a string, b string, c string, d string")
    got = {r["field"]: (r["kappa"], r["label"]) for r in association.kappa_table(p, {"one": ("a", "b"), "two": ("c", "d")}).collect()}
    assert got == {"one": (0.5, "Moderate"), "two": (1.0, "Almost Perfect"), "mean": (0.75, "Substantial")}


def test_divergence_summary(spark):
    t = inequality.divergence_table(spark.createDataFrame([("p", 5, 0), ("q", 0, 7), ("r", 1, 1)], "t string, a long, b long"), "t", "a", "b")
    r = inequality.divergence_summary(t, 2).first()
    assert r["topics"] == 3 and [x.split(":")[0] for x in r["top"].split("; ")] == ["q", "p"]


def test_structure(spark):
    from plenum.operators import structure

    rows = [("forum", "ann", "2024-01-01T00:00:00Z", None), ("forum", "bob", "2024-01-07T23:00:00Z", 1), ("forum", "ann", "2024-01-08T00:00:00Z", 2), ("github", "", "2024-02-01", None), ("forum", "zed", "no date", 1)]
    r = structure.forum_metrics(spark.createDataFrame(rows, "source string, author string, date string, reply_to_post_number int")).first()
    assert (r["days_active"], r["records"], r["forum_posts"], r["contributors"], r["reply_rate"], r["peak_week_posts"]) == (31, 4, 3, 2, 0.667, 2)
    cols = "source string, author string, date string, raw_text string, merged boolean, issue_url string, url string"
    rows = [("commit", "ann", "2024-03-05T1", "m", None, None, None), ("pr", "bob", "d", "p", True, None, None), ("pr", "cy", "d", "/vote", None, None, None), ("issue_comment", "bob", "d", "/vote", None, "x/issues/12", None), ("issue", "", "d", "/cancel-vote", None, None, "y/issues/3"), ("discussion_reply", "dee", "d", None, None, None, None)]
    r = structure.repository_metrics(spark.createDataFrame(rows, cols)).first()
    assert (r["total_commits"], r["first_commit"], r["pr_merge_rate"], r["vote_commands"], r["cancel_commands"], r["voted_threads"], r["voted_issue_nums"], r["cancelled_issue_nums"], r["unique_contributors"], r["disc_discussion_comments"]) == (1, "2024-03-05", 0.5, 1, 1, 1, "#12", "#3", 3, 1)  # a command to cancel is none to vote
    empty = structure.repository_metrics(spark.createDataFrame([], cols)).first()
    assert (empty["first_commit"], empty["pr_merge_rate"], empty["voted_issue_nums"]) == ("unknown", 0.0, "")
