"""Stages in order, skipped when done, and the job's command line."""

from __future__ import annotations

import pytest

from plenum import jobs
from plenum.plans import stages


def test_stages_run_once(spark, tmp_path):
    rows = [("r1", "annx", "first", "this is good", 0, None, None), ("r2", "bob", "first", "should not", 1, 7, None)]
    spark.createDataFrame(rows, "record_id string, author string, _case string, raw_text string, _pos long, pr_number int, issue_number int").write.parquet(f"{tmp_path}/records")
    spark.createDataFrame([("bob", "Lab", "github_bio")], "canonical string, institution string, source string").write.parquet(f"{tmp_path}/affiliations")
    spark.createDataFrame([(0, "ann", "annx", None)], "_pos long, canonical string, github_handle string, forum_handle string").write.parquet(f"{tmp_path}/alias_profiles")
    t = stages.run_stages(spark, stages.DISCOURSE, str(tmp_path))
    assert {r["canonical"]: r["institution_final"] for r in t["profiles"].collect()} == {"ann": "Unknown", "bob": "Lab"}
    assert t["category_counts"].agg({"n": "sum"}).first()[0] == 2
    calls = []
    again = [stages.Stage(s.name, s.inputs, lambda *a, s=s: calls.append(s.name) or s.run(*a)) for s in stages.DISCOURSE]
    stages.run_stages(spark, again, str(tmp_path))
    assert calls == []
    stages.run_stages(spark, again, str(tmp_path), again={"profiles"})
    assert calls == ["profiles"]
    with pytest.raises(ValueError):
        stages.ordered([stages.Stage("a", ("b",), None)], set())


def test_job(spark, sf_dir, tmp_path):
    assert jobs.main(["category_share", sf_dir, f"{tmp_path}/o", "json"]) == 0
    assert spark.read.json(f"{tmp_path}/o").count() == 10
    assert jobs.main(["category_share", sf_dir, f"{tmp_path}/l", "json", "--limit", "3"]) == 0
    assert spark.read.json(f"{tmp_path}/l").count() == 3
    assert jobs.main(["nothing"]) == 2
