"""Structural metrics of a community from its raw records: sizes, spans, rates and peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import nullable_extract
from plenum.operators.timebins import parse_ts


def _author() -> Column:
    return F.when(F.coalesce("author", F.lit("")) != "", F.col("author"))


def forum_metrics(records: DataFrame) -> DataFrame:
    """One row from dated records: days active, records, forum posts, contributors, the share of forum posts that reply, and the posts of the busiest week (ending on Sunday)."""
    r = records.withColumn("_ts", parse_ts(F.col("date"))).filter("_ts is not null")
    forum = F.col("source") == "forum"
    base = r.agg(
        F.datediff(F.max("_ts"), F.min("_ts")).cast("long").alias("days_active"), F.count("*").alias("records"), F.count_if(forum).alias("forum_posts"), F.count_distinct(_author()).alias("contributors"),
        F.round(F.coalesce(F.try_divide(F.count_if(forum & F.col("reply_to_post_number").isNotNull()), F.count_if(forum)), F.lit(0.0)), 3).alias("reply_rate"),
    )
    weeks = r.filter(forum & _author().isNotNull()).groupBy(F.date_trunc("week", "_ts").alias("w")).agg(F.count("*").alias("n"))
    return base.crossJoin(weeks.agg(F.coalesce(F.max("n"), F.lit(0)).alias("peak_week_posts")))  # one row each


def repository_metrics(records: DataFrame) -> DataFrame:
    """One row: commits with their authors and span, pull requests with the rate of merged ones, records by kind, contributors to discussions, and the commands to vote and cancel with the threads they name."""
    source, t = F.col("source"), F.coalesce("raw_text", F.lit(""))
    commit, pr = source == "commit", source == "pr"
    issue = source.isin("issue", "issue_comment")
    thread = F.coalesce(nullable_extract(F.col("issue_url"), r"/issues/(\d+)"), nullable_extract(F.col("url"), r"/issues/(\d+)")).cast("long")
    vote, cancel = issue & t.contains("/vote"), issue & t.contains("/cancel-vote")
    day = F.when(commit & (F.coalesce("date", F.lit("")) != ""), F.substring("date", 1, 10))
    threads = lambda c: F.array_sort(F.collect_set(F.when(c, thread)))  # noqa: E731  the threads that were voted on
    named = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("#"), x.cast("string"))), ", ")
    kinds = {"disc_issues": ["issue"], "disc_issue_comments": ["issue_comment"], "disc_prs": ["pr"], "disc_pr_review_comments": ["pr_review_comment"], "disc_github_discussions": ["discussion"], "disc_discussion_comments": ["discussion_comment", "discussion_reply"]}
    out = records.agg(
        F.count_if(commit).alias("total_commits"), F.count_distinct(F.when(commit, _author())).alias("commit_authors"), F.coalesce(F.min(day), F.lit("unknown")).alias("first_commit"), F.coalesce(F.max(day), F.lit("unknown")).alias("last_commit"),
        F.count_if(pr).alias("total_prs"), F.count_if(pr & F.coalesce("merged", F.lit(False))).alias("merged_prs"), F.round(F.coalesce(F.try_divide(F.count_if(pr & F.coalesce("merged", F.lit(False))), F.count_if(pr)), F.lit(0.0)), 3).alias("pr_merge_rate"),
        F.count_distinct(F.when(source == "pr_review_comment", _author())).alias("review_comment_authors"), *[F.count_if(source.isin(k)).alias(name) for name, k in kinds.items()], F.count_if(source.isin([x for k in kinds.values() for x in k])).alias("total_discussion_records"),
        F.count_distinct(F.when(source.isin([x for k in kinds.values() for x in k]), _author())).alias("unique_contributors"), F.count_if(vote).alias("vote_commands"), F.count_if(cancel).alias("cancel_commands"),
        threads(vote).alias("_voted"), threads(cancel).alias("_cancelled"),
    )
    return out.withColumn("voted_threads", F.size("_voted").cast("long")).withColumn("voted_issue_nums", named("_voted")).withColumn("cancelled_issue_nums", named("_cancelled")).drop("_voted", "_cancelled")
