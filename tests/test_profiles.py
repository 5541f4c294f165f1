"""Profiles, votes and ids of small records."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.functions import ids
from plenum.operators import profiles

SCHEMA = "_pos long, canonical string, author string, source string, _case string, date string, pr_number int, issue_number int, record_type string, state string, text string, annotation struct<stakeholder_institution:string,argument_type:string,stance:string>, annotation_error string"


def records(spark, *rows):
    names = ["canonical", "author", "source", "_case", "date", "pr_number", "issue_number", "record_type", "state", "text", "annotation", "annotation_error"]
    return spark.createDataFrame([(k, *[r.get(n) for n in names]) for k, r in enumerate(rows)], SCHEMA)


def said(who, source="forum", case="first", inst=None, kind=None, stance=None, **more):
    return {"canonical": who, "author": who, "source": source, "_case": case, "annotation": (inst, kind, stance), **more}


def test_rollup_merge_roles_and_core(spark):
    df = records(
        spark, said("ann", "pr", inst="Org", kind="Technical", stance="Support", pr_number=7), said("ann", inst="Else", stance="Oppose"), said("ann", inst="Else", stance="Support", issue_number=3),
        said("ann", case="second", inst="Org", stance="Support"), said("bob", "commit"), said("cy", "github_review"), *[said("dee", "issue", case="second") for _ in range(50)],
    )
    p = profiles.rollup(df, spark.createDataFrame([("bob", "Lab", "github_bio")], "canonical string, institution string, source string"))
    got = {r["canonical"]: r for r in p.collect()}
    assert got["ann"]["institution_final"] == "Org" and got["ann"]["institution_source"] == "lm_inferred"  # of equals, the first seen
    assert got["ann"]["threads_touched"] == ["I#3", "PR#7"] and got["ann"]["stances"] == {"Support": 3, "Oppose": 1} and got["ann"]["cases"] == ["first", "second"]
    assert (got["bob"]["institution_final"], got["bob"]["institution_lm"]) == ("Lab", "Unknown")
    m = profiles.merge_manual(p, spark.createDataFrame([("ann", "True Org", "manual_R07", "Confirmed"), ("bob", "Low", "lm_inferred", "Probable")], "canonical string, institution string, source string, confidence string"))
    got = {r["canonical"]: r for r in m.collect()}
    assert (got["ann"]["institution_final"], got["ann"]["institution_lm"], got["ann"]["institution_confidence"]) == ("True Org", "Org", "Confirmed")
    assert (got["bob"]["institution_final"], got["bob"]["institution_manual"], got["bob"]["institution_confidence"]) == ("Lab", "Low", "LM_inferred")
    assert {r["canonical"]: r["role"] for r in profiles.roles(p, df).collect()} == {"ann": "Proposer", "bob": "Occasional Contributor", "cy": "Reviewer", "dee": "Community Voice"}
    assert {(r["case"], r["canonical"]) for r in profiles.core(df).collect()} == {("first", "ann"), ("second", "dee")}
    assert [r["canonical"] for r in profiles.in_both(p, "first", "second").collect()] == ["ann"]
    assert profiles.add_missing(p, spark.createDataFrame([("ann",), ("eve",)], "canonical string")).count() == 5
    assert "Support:3" in profiles.summary_row(p).filter("canonical = 'ann'").first()["stances_summary"]


def test_votes(spark):
    bot = {"author": "git-vote[bot]", "record_type": "issue_comment", "pr_number": 1, "date": "2024-01-02T00:00:00Z"}
    df = records(
        spark, {"author": "ann", "record_type": "pr_body", "pr_number": 1, "date": "2024-01-01T00:00:00Z", "text": "x"}, {"author": "bob", "record_type": "issue_comment", "pr_number": 1, "text": " /vote "}, {"author": "bob", "record_type": "issue_comment", "pr_number": 1, "text": "/cancel-vote"},
        bot | {"text": "Vote created"}, bot | {"text": "Vote closed: passed\n:white_check_mark: | @ann\n:white_check_mark: @cy-x\n:x: @dee"}, bot | {"text": "closed"}, {"author": "ed", "record_type": "review", "state": "APPROVED", "pr_number": 1},
    )
    assert [r["event"] for r in profiles.vote_lifecycle(df).collect()] == ["PR Opened", "/vote issued", "/cancel-vote issued", "Vote opened (bot)", "Vote closed (bot)", "Merged"]
    v = profiles.vote_results(df).first()
    assert (v["final_status"], v["in_favour"], v["against"], v["bot_log"], v["vote_triggers"]) == ("CLOSED/REJECTED", ["ann", "cy-x"], ["dee"], 2, 1)
    life = records(spark, {"source": "github_pr_body", "author": "a"}, {"source": "github_review", "state": "APPROVED", "author": "Merge-Bot"}, {"source": "github_review", "state": "APPROVED", "author": "b"}, {"source": "github_review", "state": "COMMENTED", "author": "b"})
    assert [r["stage"] for r in profiles.proposal_lifecycle(life, "merge-bot").collect()] == ["PR Submitted", "Auto-merge (bot)", "EIP Editor Approved"]
    long = records(spark, {"author": "a", "text": "t" * 700}, {"author": "ci[bot]", "text": "t" * 40}, {"author": None, "text": "short"}, {"text": None})
    assert [len(r["text"]) for r in profiles.substantive(long, ["ci[bot]"]).collect()] == [600]


def test_coverage(spark):
    raw = spark.createDataFrame([("a",), ("b",), ("c",)], "record_id string")
    done = spark.createDataFrame([("a", None), ("b", "x"), ("b", None)], "record_id string, annotation_error string")
    r = profiles.coverage(raw, done)
    assert tuple(r.first()) == (3, 2, 0, 1, "FAIL")
    try:
        profiles.require_coverage(r)
        raise AssertionError
    except ValueError:
        pass
    profiles.require_coverage(profiles.coverage(raw.filter("record_id <> 'c'"), done))


def test_ids(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    none, lit = F.lit(None).cast("string"), F.lit
    assert one(ids.record_id(lit("A"), lit("pr"), [none, lit(""), lit(0), lit("s1")], none)) == "A_pr_s1_None"
    assert one(ids.url_or_composite_id(lit(" https://u "), lit("A"), lit("pr"), [none], lit("t"))) == "https://u"
    assert one(ids.url_or_composite_id(lit(" "), lit("A"), none, [lit(5)], lit("t"))) == "A_?_5"
    assert one(F.length(ids.url_or_composite_id(none, lit("A"), lit("pr"), [none], lit("t")))) == 5 + 64
    assert one(ids.vote_record_id(lit(7), lit("review"), lit(9))) == "gitvote|pr7|review|9"
    assert [one(ids.source_group(lit(s))) for s in ("issue", "review", "discussion_reply", "x")] == ["issues", "prs", "discussions", "other"]
    assert one(ids.record_url(lit("forum"), lit(3), none, "https://f/t/")) == "https://f/t/3" and one(ids.record_url(lit("pr"), none, none, "f")) == ""
    assert one(ids.case_of(lit("X-forum-1"), ["ab"], ["forum"], "one", "two")) == "one"
    palette = [("Acme Labs", "red"), ("Beta", "blue")]
    assert [one(ids.colour(lit(n), palette, "grey")) for n in ("Beta", "acme labs inc", "acme", "zed")] == ["blue", "red", "red", "grey"]
    assert one(ids.colour(lit("acme"), palette, "grey", both_ways=False)) == "grey"
    assert one(ids.clipped(lit("abcdefgh"), 4)) == "abc…"
