"""Queries on time, ranks and cumulative sums."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.operators import structure, timebins
from plenum.plans.registry import EV, discourse, query
from plenum.storage import table


@query(
    f"""WITH {EV}, s AS (SELECT case_id, min(ts) AS t0 FROM ev GROUP BY 1),
  b AS (SELECT ev.case_id, CAST((epoch_us(ts) - epoch_us(t0)) // (14 * 86400000000) AS BIGINT) AS bin, category, count(*) AS n FROM ev JOIN s USING (case_id) GROUP BY ALL)
  SELECT case_id, bin, category, n, round(100.0 * n / sum(n) OVER (PARTITION BY case_id, bin), 6) AS pct FROM b"""
)
def anchored_bins(spark, sf_dir):
    return timebins.anchored_bins(discourse(spark, sf_dir), "case_id", "ts", "category", 14)


@query(
    """WITH s AS (SELECT o_orderstatus, min(o_orderdate) AS t0 FROM orders GROUP BY 1),
  b AS (SELECT o_orderstatus, CAST((epoch_us(o_orderdate) - epoch_us(t0)) // (30 * 86400000000) AS BIGINT) AS bin, o_orderpriority, count(*) AS n FROM orders JOIN s USING (o_orderstatus) GROUP BY ALL)
  SELECT *, round(100.0 * n / sum(n) OVER (PARTITION BY o_orderstatus, bin), 6) AS pct FROM b"""
)
def anchored_bins_monthly(spark, sf_dir):
    return timebins.anchored_bins(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderdate", "o_orderpriority", 30)


@query(
    f"""WITH {EV}, w AS (SELECT case_id, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM ev GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, week) AS i FROM w)
  SELECT case_id, max(CAST(week AS VARCHAR)) FILTER (i = 1) AS peak_week, max(n) FILTER (i = 1) AS peak_n, CAST(date_diff('day', min(week), max(week)) / 7 + 1 AS BIGINT) AS weeks FROM r GROUP BY 1"""
)
def weekly_peak(spark, sf_dir):
    return timebins.weekly_peak(discourse(spark, sf_dir), "case_id", "ts")


@query(
    """WITH t AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS roles, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (turn > 0) AS replies, max(turn) AS last_turn FROM conversations GROUP BY 1)
  SELECT count(*) AS threads, CAST(sum(n) AS BIGINT) AS records, round(avg(n), 6) AS mean_length, CAST(sum(user_turns) AS BIGINT) AS user_turns, CAST(sum(replies) AS BIGINT) AS replies, round(CAST(sum(replies) AS DOUBLE) / sum(n), 6) AS reply_rate, max(roles) AS max_roles FROM t"""
)
def reply_topology(spark, sf_dir):
    """Thread metrics: records, replies and their rate."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("n"), F.countDistinct("role").alias("roles"), F.count_if(F.expr("role = 'user'")).alias("user_turns"), F.count_if(F.expr("turn > 0")).alias("replies")
    )
    return t.agg(
        F.count("*").alias("threads"), F.sum("n").alias("records"), F.round(F.avg("n"), 6).alias("mean_length"), F.sum("user_turns").alias("user_turns"), F.sum("replies").alias("replies"),
        F.round(F.sum("replies") / F.sum("n"), 6).alias("reply_rate"), F.max("roles").alias("max_roles"),
    )


@query(
    """SELECT year(o_orderdate) AS year, count(*) AS records, count(DISTINCT o_custkey) AS authors, count(*) FILTER (o_orderstatus = 'F') AS merged, round(CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*), 6) AS merge_rate,
  date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS days_active, count(DISTINCT CAST(o_orderdate AS DATE)) AS active_days FROM orders GROUP BY 1"""
)
def structural_metrics(spark, sf_dir):
    """Counts, distinct authors, rate of finished records and span, from dated rows only."""
    o = table(spark, sf_dir, "orders").filter("o_orderdate is not null")
    return o.groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(
        F.count("*").alias("records"), F.countDistinct("o_custkey").alias("authors"), F.count_if(F.expr("o_orderstatus = 'F'")).alias("merged"),
        F.round(F.count_if(F.expr("o_orderstatus = 'F'")) / F.count("*"), 6).alias("merge_rate"),
        F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).cast("long").alias("days_active"), F.countDistinct(F.to_date("o_orderdate")).alias("active_days"),
    )


@query(
    """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, user_id) AS i, lead(n) OVER (ORDER BY n DESC, user_id) AS m FROM c),
  d AS (SELECT i, (n - m) / CAST(n AS DOUBLE) AS drop FROM r WHERE m IS NOT NULL AND i BETWEEN 20 AND 80)
  SELECT least(80, coalesce((SELECT i FROM d ORDER BY drop DESC, i LIMIT 1), (SELECT count(*) FROM c))) AS cutoff"""
)
def elbow_cutoff(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return timebins.elbow_cutoff(counts, "n", "user_id")


@query(
    """WITH r AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1), t AS (SELECT n_regionkey, s_suppkey, revenue, revenue / sum(revenue) OVER () AS share,
  row_number() OVER (PARTITION BY n_regionkey ORDER BY revenue DESC, s_suppkey) AS i FROM r JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)
  SELECT n_regionkey, s_suppkey, round(revenue, 2) AS revenue, round(share, 6) AS share, i AS rank FROM t WHERE i <= 3"""
)
def topk_share(spark, sf_dir):
    """The three largest suppliers of each region, with their share of the whole."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    s = line.join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    total = line.agg(F.sum("revenue").alias("total"))
    w = Window.partitionBy("n_regionkey").orderBy(F.desc("revenue"), "s_suppkey")
    s = s.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").crossJoin(F.broadcast(total))  # one row
    return s.select("n_regionkey", "s_suppkey", "revenue", F.round(F.col("revenue") / F.col("total"), 6).alias("share"), F.col("rank").cast("long").alias("rank"))


@query(
    """WITH r AS (SELECT r_name, n_name, row_number() OVER (ORDER BY r_name, n_name) AS i, lag(r_name) OVER (ORDER BY r_name, n_name) AS p FROM nation JOIN region ON r_regionkey = n_regionkey)
  SELECT r_name AS grp, n_name AS label, i AS pos, false AS is_separator FROM r UNION ALL SELECT r_name, NULL, i, true FROM r WHERE p IS DISTINCT FROM r_name"""
)
def separator_rows(spark, sf_dir):
    """Rows in order of their group, with one more row before each group."""
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    w = Window.orderBy("r_name", "n_name")  # a row for each label of a drawing
    r = j.select("r_name", "n_name", F.row_number().over(w).cast("long").alias("pos"), F.lag("r_name").over(w).alias("before"))
    lines = r.filter(~F.col("before").eqNullSafe(F.col("r_name"))).select(F.col("r_name").alias("grp"), F.lit(None).cast("string").alias("label"), "pos", F.lit(True).alias("is_separator"))
    return r.select(F.col("r_name").alias("grp"), F.col("n_name").alias("label"), "pos", F.lit(False).alias("is_separator")).unionByName(lines)


@query(
    f"""WITH {EV}, c AS (SELECT day, category, count(*) AS n FROM ev GROUP BY ALL)
  SELECT day, category, n, CAST(coalesce(sum(n) OVER (PARTITION BY day ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bottom, row_number() OVER (PARTITION BY day ORDER BY n DESC, category) AS rank,
  substr(day, 1, 7) <> coalesce(substr(lag(day) OVER (PARTITION BY category ORDER BY day), 1, 7), '') AS month_tick FROM c"""
)
def cumulative_stack(spark, sf_dir):
    c = discourse(spark, sf_dir).groupBy("day", "category").agg(F.count("*").alias("n"))
    by_day = Window.partitionBy("day")
    before = F.lag("day").over(Window.partitionBy("category").orderBy("day"))
    return c.select(
        "day", "category", "n", F.coalesce(F.sum("n").over(by_day.orderBy("category").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bottom"),
        F.row_number().over(by_day.orderBy(F.desc("n"), "category")).cast("long").alias("rank"), (F.substring("day", 1, 7) != F.coalesce(F.substring(before, 1, 7), F.lit(""))).alias("month_tick"),
    )


@query(
    f"""WITH {EV}, f AS (SELECT actor, min(ts) AS first_ts, count(*) AS n FROM ev GROUP BY 1)
  SELECT actor, actor % 7 AS institution, CAST(epoch_us(first_ts) // 1000 AS BIGINT) AS first_ms, n, row_number() OVER (PARTITION BY actor % 7 ORDER BY first_ts, actor) AS row_in_group FROM f"""
)
def timeline_rows(spark, sf_dir):
    f = discourse(spark, sf_dir).groupBy("actor").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).withColumn("institution", F.col("actor") % 7)
    w = Window.partitionBy("institution").orderBy("first_ts", "actor")
    return f.select("actor", "institution", F.floor(timebins.micros(F.col("first_ts")) / 1000).alias("first_ms"), "n", F.row_number().over(w).cast("long").alias("row_in_group"))


_RAW = """raw AS (SELECT CASE o_orderkey % 9 WHEN 0 THEN 'forum' WHEN 1 THEN 'commit' WHEN 2 THEN 'issue' WHEN 3 THEN 'issue_comment' WHEN 4 THEN 'pr' WHEN 5 THEN 'pr_review_comment' WHEN 6 THEN 'discussion' WHEN 7 THEN 'discussion_comment' ELSE 'discussion_reply' END AS source,
  CASE WHEN o_custkey % 50 = 0 THEN '' ELSE 'u' || o_custkey END AS author, CASE WHEN o_orderkey % 40 = 9 THEN 'no date' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS date, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS INTEGER) END AS reply_to_post_number, o_orderstatus = 'F' AS merged, o_orderdate AS ts,
  CASE WHEN o_orderkey % 10 = 2 THEN 'please /vote' WHEN o_orderkey % 10 = 3 THEN '/cancel-vote' ELSE 'text' END AS raw_text, CASE WHEN o_orderkey % 3 = 0 THEN 'https://api/repos/issues/' || (o_custkey % 40) END AS issue_url, 'https://host/issues/' || (o_custkey % 7) || '#c' AS url FROM orders)"""


def _raw(spark, sf_dir):
    date = F.when(F.col("o_orderkey") % 40 == 9, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "o_orderdate", "CASE o_orderkey % 9 WHEN 0 THEN 'forum' WHEN 1 THEN 'commit' WHEN 2 THEN 'issue' WHEN 3 THEN 'issue_comment' WHEN 4 THEN 'pr' WHEN 5 THEN 'pr_review_comment' WHEN 6 THEN 'discussion' WHEN 7 THEN 'discussion_comment' ELSE 'discussion_reply' END AS source",
        "CASE WHEN o_custkey % 50 = 0 THEN '' ELSE 'u' || o_custkey END AS author", "CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS INT) END AS reply_to_post_number", "o_orderstatus = 'F' AS merged",
        "CASE WHEN o_orderkey % 10 = 2 THEN 'please /vote' WHEN o_orderkey % 10 = 3 THEN '/cancel-vote' ELSE 'text' END AS raw_text", "CASE WHEN o_orderkey % 3 = 0 THEN 'https://api/repos/issues/' || (o_custkey % 40) END AS issue_url", "'https://host/issues/' || (o_custkey % 7) || '#c' AS url",
    ).withColumn("date", date)


@query(
    f"""WITH {_RAW}, r AS (SELECT * FROM raw WHERE date <> 'no date'), w AS (SELECT date_trunc('week', ts) AS w, count(*) AS n FROM r WHERE source = 'forum' AND author <> '' GROUP BY 1)
  SELECT date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS days_active, count(*) AS records, count(*) FILTER (source = 'forum') AS forum_posts, count(DISTINCT nullif(author, '')) AS contributors,
  round(count(*) FILTER (source = 'forum' AND reply_to_post_number IS NOT NULL) / CAST(count(*) FILTER (source = 'forum') AS DOUBLE), 3) AS reply_rate, (SELECT coalesce(max(n), 0) FROM w) AS peak_week_posts FROM r"""
)
def forum_metrics(spark, sf_dir):
    """A forum's structure."""
    return structure.forum_metrics(_raw(spark, sf_dir))


_NUMBER = "CAST(coalesce(nullif(regexp_extract(issue_url, '/issues/([0-9]+)', 1), ''), nullif(regexp_extract(url, '/issues/([0-9]+)', 1), '')) AS BIGINT)"
_NAMED = "(SELECT coalesce(string_agg('#' || t, ', ' ORDER BY t), '') FROM (SELECT DISTINCT {n} AS t FROM raw WHERE source IN ('issue', 'issue_comment') AND contains(raw_text, '{c}')))"


@query(
    f"""WITH {_RAW} SELECT count(*) FILTER (source = 'commit') AS total_commits, count(DISTINCT nullif(author, '')) FILTER (source = 'commit') AS commit_authors, min(substr(date, 1, 10)) FILTER (source = 'commit') AS first_commit, max(substr(date, 1, 10)) FILTER (source = 'commit') AS last_commit,
  count(*) FILTER (source = 'pr') AS total_prs, count(*) FILTER (source = 'pr' AND merged) AS merged_prs, round(count(*) FILTER (source = 'pr' AND merged) / CAST(count(*) FILTER (source = 'pr') AS DOUBLE), 3) AS pr_merge_rate, count(DISTINCT nullif(author, '')) FILTER (source = 'pr_review_comment') AS review_comment_authors,
  count(*) FILTER (source = 'issue') AS disc_issues, count(*) FILTER (source = 'issue_comment') AS disc_issue_comments, count(*) FILTER (source = 'pr') AS disc_prs, count(*) FILTER (source = 'pr_review_comment') AS disc_pr_review_comments, count(*) FILTER (source = 'discussion') AS disc_github_discussions,
  count(*) FILTER (source IN ('discussion_comment', 'discussion_reply')) AS disc_discussion_comments, count(*) FILTER (source NOT IN ('forum', 'commit')) AS total_discussion_records, count(DISTINCT nullif(author, '')) FILTER (source NOT IN ('forum', 'commit')) AS unique_contributors,
  count(*) FILTER (source IN ('issue', 'issue_comment') AND contains(raw_text, '/vote')) AS vote_commands, count(*) FILTER (source IN ('issue', 'issue_comment') AND contains(raw_text, '/cancel-vote')) AS cancel_commands,
  count(DISTINCT {_NUMBER}) FILTER (source IN ('issue', 'issue_comment') AND contains(raw_text, '/vote')) AS voted_threads, {_NAMED.format(n=_NUMBER, c='/vote')} AS voted_issue_nums, {_NAMED.format(n=_NUMBER, c='/cancel-vote')} AS cancelled_issue_nums FROM raw"""
)
def repository_metrics(spark, sf_dir):
    """A repository's structure."""
    return structure.repository_metrics(_raw(spark, sf_dir))
