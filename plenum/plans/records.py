"""Queries that call the record, profile, vote and id functions on the orders table, dressed as discourse records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions import ids as names
from plenum.functions import predicates, text
from plenum.operators import annotate, identity, profiles
from plenum.plans.registry import query
from plenum.storage import table

#: Fields of a record by their expressions, which both dialects read alike.
FIELDS = {
    "_pos": "o_orderkey",
    "author": "CASE WHEN o_orderkey % 11 = 0 THEN 'git-vote[bot]' WHEN o_orderkey % 13 = 0 THEN 'eip-review-bot' ELSE 'User' || o_custkey END",
    "_case": "CASE WHEN o_custkey % 3 = 0 THEN 'second' ELSE 'first' END",
    "source": "CASE o_orderkey % 7 WHEN 0 THEN 'forum' WHEN 1 THEN 'github_pr_body' WHEN 2 THEN 'github_review' WHEN 3 THEN 'github_review_comment' WHEN 4 THEN 'commit' WHEN 5 THEN 'issue_comment' ELSE 'pr' END",
    "record_type": "CASE o_orderkey % 7 WHEN 1 THEN 'pr_body' WHEN 2 THEN 'review' ELSE 'issue_comment' END",
    "pr_number": "CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 53 AS INTEGER) END",
    "issue_number": "CASE WHEN o_orderkey % 6 = 3 THEN CAST(o_custkey % 31 AS INTEGER) END",
    "post_id": "CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey * 10 END",
    "comment_id": "CASE WHEN o_orderkey % 7 = 5 THEN 'c' || o_orderkey WHEN o_orderkey % 7 = 6 THEN '0' END",
    "state": "CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'P' THEN 'CHANGES_REQUESTED' ELSE 'COMMENTED' END",
    "text": "CASE o_orderkey % 10 WHEN 0 THEN '/vote' WHEN 1 THEN ' /cancel-vote please' WHEN 2 THEN 'Vote created by @u' || (o_custkey % 9) WHEN 3 THEN 'Vote status' || chr(10) || ':white_check_mark: @yes' || (o_custkey % 5) || chr(10) || ':x: @no-' || (o_custkey % 4) "
    "WHEN 4 THEN 'Vote closed, it passed' WHEN 5 THEN 'It is closed' WHEN 6 THEN NULL WHEN 7 THEN '  short  ' ELSE 'A longer comment on priority ' || o_orderpriority || ' of order ' || o_orderkey END",
    "url": "CASE o_orderkey % 5 WHEN 0 THEN 'https://api.example.org/pulls/' || (o_custkey % 53) WHEN 1 THEN 'https://api.example.org/issues/' || (o_custkey % 31) WHEN 2 THEN ' https://forum.example.org/t/' || o_orderkey || ' ' WHEN 3 THEN '' END",
    "institution": "CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Google' WHEN 2 THEN 'MetaMask' WHEN 3 THEN 'Independent' END",
    "argument": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Technical' WHEN '2' THEN 'Process' WHEN '3' THEN 'Economic' WHEN '4' THEN 'Governance-Principle' ELSE '' END",
    "stance": "CASE o_orderkey % 4 WHEN 0 THEN 'Support' WHEN 1 THEN 'Oppose' WHEN 2 THEN 'Modify' ELSE 'Neutral' END",
    "annotation_error": "CASE WHEN o_orderkey % 17 = 0 THEN 'json_parse: {' || o_orderkey WHEN o_orderkey % 19 = 0 THEN 'api_error: timeout' WHEN o_orderkey % 23 = 0 THEN 'text_too_short' END",
}
REC = "rec AS (SELECT " + ", ".join(f"{x} AS {c}" for c, x in FIELDS.items()) + ", strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS date FROM orders)"
REC_C = REC + ", al AS (SELECT alias, arg_max(canonical, pos) AS canonical FROM (SELECT 'User' || s_suppkey AS alias, 'User' || s_suppkey AS canonical, s_suppkey AS pos FROM supplier UNION ALL SELECT 'User' || (s_suppkey + 100), 'User' || s_suppkey, s_suppkey FROM supplier) GROUP BY 1), r AS (SELECT rec.*, coalesce(al.canonical, author) AS canonical FROM rec LEFT JOIN al ON alias = author)"
_COMPANY = "CASE s_suppkey % 5 WHEN 0 THEN '@Google Cloud' WHEN 1 THEN 'MetaMask' WHEN 2 THEN '' END"
_BIO = "CASE s_suppkey % 3 WHEN 0 THEN 'PhD at a University' WHEN 1 THEN 'freelance developer' END"
AFFILIATED = "aff AS (SELECT 'User' || s_suppkey AS canonical, CASE WHEN s_suppkey % 5 = 0 THEN 'Google' WHEN s_suppkey % 5 = 1 THEN 'MetaMask' WHEN s_suppkey % 3 = 0 THEN 'Academia' WHEN s_suppkey % 3 = 1 THEN 'Independent' END AS institution, CASE WHEN s_suppkey % 5 IN (0, 1) THEN 'github_company_field' WHEN s_suppkey % 3 IN (0, 1) THEN 'github_bio' END AS source FROM supplier)"


def records(spark, sf_dir) -> DataFrame:
    date = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date")
    r = table(spark, sf_dir, "orders").select(*[F.expr(x).alias(c) for c, x in FIELDS.items()], date)
    return r.withColumn("annotation", F.struct(F.col("institution").alias("stakeholder_institution"), F.col("argument").alias("argument_type"), "stance"))


def people(spark, sf_dir) -> DataFrame:
    """Profiles under two handles each, with what they say of themselves."""
    s = table(spark, sf_dir, "supplier")
    return s.selectExpr("'User' || s_suppkey AS canonical", "'User' || s_suppkey AS github_handle", "'User' || (s_suppkey + 100) AS forum_handle", "s_suppkey AS _pos", f"{_COMPANY} AS company", f"{_BIO} AS bio", "s_name AS name", "s_acctbal", "s_nationkey")


def canonical_records(spark, sf_dir) -> DataFrame:
    a = identity.aliases(people(spark, sf_dir), "canonical", ["canonical", "github_handle", "forum_handle"], "_pos")
    return identity.canonical(records(spark, sf_dir), "author", a)


def affiliations(spark, sf_dir) -> DataFrame:
    found = text.with_source([("github_company_field", F.col("company")), ("github_bio", F.col("bio"))])
    return people(spark, sf_dir).select("canonical", found.alias("i")).filter("i is not null").select("canonical", "i.institution", "i.source")


def rolled(spark, sf_dir) -> DataFrame:
    return profiles.rollup(canonical_records(spark, sf_dir), affiliations(spark, sf_dir))


def sorted_map(c: str) -> Column:
    """k:v; k:v in the order of the text."""
    return F.coalesce(F.array_join(F.sort_array(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))), "; "), F.lit(""))


_MAP = "SELECT canonical, string_agg({c} || ':' || n, '; ' ORDER BY {c} || ':' || n) AS m FROM (SELECT canonical, {c}, count(*) AS n FROM r WHERE {c} <> '' GROUP BY 1, 2) GROUP BY 1"
ROLL = f"""{REC_C}, {AFFILIATED}, base AS (SELECT canonical, count(*) AS total_records, string_agg(DISTINCT _case, ',' ORDER BY _case) AS cases,
    coalesce(string_agg(DISTINCT CASE WHEN pr_number IS NOT NULL THEN 'PR#' || pr_number WHEN issue_number IS NOT NULL THEN 'I#' || issue_number END, ',' ORDER BY CASE WHEN pr_number IS NOT NULL THEN 'PR#' || pr_number WHEN issue_number IS NOT NULL THEN 'I#' || issue_number END), '') AS threads FROM r GROUP BY 1),
  lm AS (SELECT canonical, institution FROM (SELECT canonical, institution, row_number() OVER (PARTITION BY canonical ORDER BY count(*) DESC, min(_pos)) AS i FROM r WHERE institution <> '' GROUP BY 1, 2) WHERE i = 1),
  ma AS ({_MAP.format(c='argument')}), ms AS ({_MAP.format(c='stance')}),
  roll AS (SELECT base.*, coalesce(lm.institution, 'Unknown') AS institution_lm, coalesce(aff.institution, lm.institution, 'Unknown') AS institution_final, coalesce(aff.source, 'lm_inferred') AS institution_source, coalesce(ma.m, '') AS argument_types, coalesce(ms.m, '') AS stances
    FROM base LEFT JOIN lm USING (canonical) LEFT JOIN (SELECT * FROM aff WHERE institution IS NOT NULL) aff USING (canonical) LEFT JOIN ma USING (canonical) LEFT JOIN ms USING (canonical))"""


@query(f"WITH {ROLL} SELECT canonical, total_records, cases, threads, institution_lm, institution_final, institution_source, argument_types, stances FROM roll")
def author_rollup(spark, sf_dir):
    """One row for each canonical author: records, cases, threads, affiliation with its source, and counts."""
    p = rolled(spark, sf_dir)
    return p.select("canonical", "total_records", F.array_join("cases", ",").alias("cases"), F.array_join("threads_touched", ",").alias("threads"), "institution_lm", "institution_final", "institution_source", sorted_map("argument_types").alias("argument_types"), sorted_map("stances").alias("stances"))


@query(
    f"""WITH {REC_C}, n AS (SELECT canonical, count(*) AS total, count(*) FILTER (source IN ('github_pr_body', 'pr')) AS pr, count(*) FILTER (source = 'forum') AS forum, count(*) FILTER (source IN ('github_review', 'review_comment')) AS review, count(*) FILTER (source = 'commit') AS commits,
    count(*) FILTER (stance = 'Support') AS yes, count(*) FILTER (stance = 'Oppose') AS no, count(*) FILTER (argument = 'Technical') AS technical, count(*) FILTER (argument = 'Process') AS process FROM r GROUP BY 1)
  SELECT canonical, CASE WHEN (pr > 0 OR forum > 3) AND yes > no AND total >= 3 THEN 'Proposer' WHEN (commits > 0 OR technical > 0.5 * total) AND total >= 5 THEN 'Core Developer' WHEN review > 0 OR process > 0 THEN 'Reviewer' WHEN total >= 5 THEN 'Community Voice' ELSE 'Occasional Contributor' END AS role FROM n"""
)
def role_inference(spark, sf_dir):
    """A role for each author, by the first rule that holds."""
    return profiles.roles(rolled(spark, sf_dir), canonical_records(spark, sf_dir))


@query(
    f"""WITH {REC_C}, n AS (SELECT _case AS "case", canonical, count(*) AS case_records, count(DISTINCT pr_number) AS case_threads, count(*) FILTER (source = 'forum') AS forum_posts FROM r GROUP BY 1, 2)
  SELECT * FROM n WHERE ("case" = 'first' AND (case_records >= 3 OR case_threads >= 2)) OR ("case" = 'second' AND case_records >= 50)"""
)
def core_contributors(spark, sf_dir):
    """Authors whom their case's rule selects; records under two handles of one author count once."""
    return profiles.core(canonical_records(spark, sf_dir))


_MANUAL = "man AS (SELECT 'User' || s_suppkey AS canonical, n_name AS institution, CASE WHEN s_suppkey % 2 = 0 THEN 'manual_R07' WHEN s_suppkey % 3 = 0 THEN 'eip_header_email' ELSE 'github_bio' END AS source, CASE WHEN s_acctbal > 5000 THEN 'Confirmed' ELSE 'Probable' END AS confidence FROM supplier JOIN nation ON n_nationkey = s_nationkey)"
_RANK = "CASE {c} WHEN 'eip_header_email' THEN 7 WHEN 'manual_R07' THEN 6 WHEN 'github_company_field' THEN 3 WHEN 'github_bio' THEN 2 WHEN 'forum_bio' THEN 2 WHEN 'lm_inferred' THEN 1 ELSE 0 END"


@query(
    f"""WITH {ROLL}, {_MANUAL}, j AS (SELECT roll.*, man.institution AS institution_manual, man.source AS ms, man.confidence AS mc, man.institution IS NOT NULL AND {_RANK.format(c='man.source')} >= {_RANK.format(c='institution_source')} AS wins FROM roll LEFT JOIN man USING (canonical))
  SELECT canonical, CASE WHEN wins THEN institution_manual ELSE institution_final END AS institution_final, CASE WHEN wins THEN ms ELSE institution_source END AS institution_source, institution_lm, institution_manual,
  CASE WHEN wins THEN mc WHEN institution_manual IS NOT NULL THEN 'LM_inferred' WHEN institution_source = 'github_company_field' THEN 'Strong' WHEN institution_source IN ('github_bio', 'forum_bio') THEN 'Probable' ELSE 'LM_inferred' END AS institution_confidence FROM j"""
)
def manual_promotion(spark, sf_dir):
    """What was looked up by hand is promoted where its source ranks at least as high; the model's label stays."""
    p = people(spark, sf_dir).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    manual = p.selectExpr("canonical", "n_name AS institution", "CASE WHEN _pos % 2 = 0 THEN 'manual_R07' WHEN _pos % 3 = 0 THEN 'eip_header_email' ELSE 'github_bio' END AS source", "CASE WHEN s_acctbal > 5000 THEN 'Confirmed' ELSE 'Probable' END AS confidence")
    return profiles.merge_manual(rolled(spark, sf_dir), manual).select("canonical", "institution_final", "institution_source", "institution_lm", "institution_manual", "institution_confidence")


_ENTRY = "e AS (SELECT lower(s_name) AS handle, n_name AS institution, CASE WHEN s_suppkey % 4 = 0 THEN 'manual_R07' ELSE 'github_bio' END AS source, CASE WHEN s_acctbal > 5000 THEN 'Confirmed' ELSE 'Probable' END AS confidence, s_suppkey AS pos FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 3 > 0)"


@query(
    f"""WITH {_ENTRY}, p AS (SELECT 'P' || s_suppkey AS canonical, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE upper(s_name) END AS canonical_handle, CASE WHEN s_suppkey % 6 = 0 THEN 'Supplier#' || lpad(CAST(s_suppkey + 1 AS VARCHAR), 9, '0') END AS github_handle, CASE WHEN s_suppkey % 9 = 3 THEN 'SUPPLIER#' || lpad(CAST(s_suppkey - 1 AS VARCHAR), 9, '0') END AS forum_handle FROM supplier),
  h AS (SELECT canonical, unnest([canonical_handle, github_handle, forum_handle]) AS handle, unnest([1, 2, 3]) AS i FROM p)
  SELECT p.canonical, arg_min(e.institution, h.i) AS institution, arg_min(h.i, h.i) AS found_by FROM p LEFT JOIN h ON h.canonical = p.canonical AND lower(h.handle) IN (SELECT handle FROM e) LEFT JOIN e ON e.handle = lower(h.handle) GROUP BY 1"""
)
def manual_lookup(spark, sf_dir):
    """The entry that a profile's handles find first: the canonical one, the code host's, then the forum's."""
    s = table(spark, sf_dir, "supplier")
    entries = s.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).filter("s_suppkey % 3 > 0").selectExpr("s_name AS handle", "n_name AS institution", "CASE WHEN s_suppkey % 4 = 0 THEN 'manual_R07' ELSE 'github_bio' END AS source", "CASE WHEN s_acctbal > 5000 THEN 'Confirmed' ELSE 'Probable' END AS confidence", "s_suppkey AS pos")
    p = s.selectExpr("'P' || s_suppkey AS canonical", "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE upper(s_name) END AS canonical_handle", "CASE WHEN s_suppkey % 6 = 0 THEN 'Supplier#' || lpad(CAST(s_suppkey + 1 AS STRING), 9, '0') END AS github_handle", "CASE WHEN s_suppkey % 9 = 3 THEN 'SUPPLIER#' || lpad(CAST(s_suppkey - 1 AS STRING), 9, '0') END AS forum_handle")
    best = identity.best_entry(entries, "handle", "source", "confidence", "pos")
    return identity.lookup(p, "canonical", ["canonical_handle", "github_handle", "forum_handle"], best).select("canonical", "institution", "found_by")


@query(f"WITH {REC_C}, p AS (SELECT 'User' || s_suppkey AS canonical, s_name AS name FROM supplier) SELECT canonical, name FROM p UNION ALL SELECT DISTINCT canonical, CAST(NULL AS VARCHAR) FROM r WHERE _case = 'second' AND canonical NOT IN (SELECT canonical FROM p)")
def missing_profiles(spark, sf_dir):
    """Profiles, and a row for each author of the second case who has none."""
    authors = canonical_records(spark, sf_dir).filter("_case = 'second'").select("canonical").distinct()
    return profiles.add_missing(people(spark, sf_dir).select("canonical", "name"), authors)


@query(
    f"""WITH {REC} SELECT * FROM (SELECT substr(date, 1, 10) AS date, CASE WHEN source = 'github_pr_body' THEN 'PR Submitted' WHEN source = 'github_review' AND state = 'APPROVED' AND lower(author) LIKE '%eip-review-bot%' THEN 'Auto-merge (bot)' WHEN source = 'github_review' AND state = 'APPROVED' THEN 'EIP Editor Approved' WHEN source = 'github_review_comment' THEN 'Review Comment' END AS stage, author FROM rec) WHERE stage IS NOT NULL"""
)
def lifecycle_events(spark, sf_dir):
    """The stages of proposals."""
    return profiles.proposal_lifecycle(records(spark, sf_dir), "eip-review-bot")


@query(
    f"""WITH {REC}, e AS (SELECT pr_number, substr(date, 1, 10) AS date, lower(author) LIKE '%bot%' AS bot, record_type = 'issue_comment' AS comment, coalesce(text, '') AS t, author, record_type, state FROM rec),
  v AS (SELECT pr_number, date, CASE WHEN record_type = 'pr_body' THEN 'PR Opened' WHEN comment AND NOT bot AND contains(t, '/cancel-vote') THEN '/cancel-vote issued' WHEN comment AND NOT bot AND contains(t, '/vote') THEN '/vote issued' WHEN comment AND bot AND contains(lower(t), 'vote created') THEN 'Vote opened (bot)'
    WHEN comment AND bot AND (contains(lower(t), 'vote closed') OR contains(lower(t), 'passed')) THEN 'Vote closed (bot)' WHEN record_type = 'review' AND state = 'APPROVED' THEN 'Merged' END AS event, CASE WHEN comment AND bot THEN 'git-vote[bot]' ELSE author END AS author FROM e)
  SELECT * FROM v WHERE event IS NOT NULL"""
)
def vote_lifecycle(spark, sf_dir):
    return profiles.vote_lifecycle(records(spark, sf_dir))


@query(
    rf"""WITH {REC}, e AS (SELECT *, author = 'git-vote[bot]' AS own, coalesce(text, '') AS t FROM rec),
  s AS (SELECT pr_number, arg_max(CASE WHEN contains(lower(t), 'passed') THEN 'PASSED' ELSE 'CLOSED/REJECTED' END, _pos) AS s FROM e WHERE own AND (contains(lower(t), 'passed') OR contains(lower(t), 'closed')) GROUP BY 1),
  y AS (SELECT pr_number, unnest(regexp_extract_all(t, ':white_check_mark:[^\n]*@(\w[\w-]*)', 1)) AS v FROM e WHERE own), n AS (SELECT pr_number, unnest(regexp_extract_all(t, ':x:[^\n]*@(\w[\w-]*)', 1)) AS v FROM e WHERE own),
  b AS (SELECT pr_number, count(*) FILTER (own AND regexp_matches(t, 'Vote (status|created|closed)')) AS bot_log, count(*) FILTER (record_type = 'issue_comment' AND trim(t) = '/vote') AS vote_triggers FROM e GROUP BY 1),
  yy AS (SELECT pr_number, string_agg(DISTINCT v, ',' ORDER BY v) AS v FROM y GROUP BY 1), nn AS (SELECT pr_number, string_agg(DISTINCT v, ',' ORDER BY v) AS v FROM n GROUP BY 1)
  SELECT b.pr_number, coalesce(s.s, '') AS final_status, coalesce(yy.v, '') AS in_favour, coalesce(nn.v, '') AS against, bot_log, vote_triggers FROM b LEFT JOIN s ON s.pr_number IS NOT DISTINCT FROM b.pr_number LEFT JOIN yy ON yy.pr_number IS NOT DISTINCT FROM b.pr_number LEFT JOIN nn ON nn.pr_number IS NOT DISTINCT FROM b.pr_number"""
)
def vote_tally(spark, sf_dir):
    """The bot's last status of each request, and the distinct voters that it names."""
    v = profiles.vote_results(records(spark, sf_dir))
    return v.select("pr_number", "final_status", F.array_join("in_favour", ",").alias("in_favour"), F.array_join("against", ",").alias("against"), "bot_log", "vote_triggers")


@query(
    f"""WITH {REC}, e AS (SELECT *, lower(author) LIKE '%bot%' AS bot, lower(author) LIKE '%eip-review-bot%' AS merger FROM rec)
  SELECT _case, count(*) FILTER (source = 'github_review' AND state = 'APPROVED' AND NOT merger) AS human_approvals, count(DISTINCT author) FILTER (source = 'github_review' AND state = 'APPROVED' AND NOT merger) AS approvers, count(*) FILTER (source = 'github_review' AND merger) AS bot_auto_merges,
  count(*) FILTER (contains(coalesce(text, ''), '/vote') AND NOT bot) AS vote_commands, count(*) FILTER (contains(coalesce(text, ''), '/cancel-vote') AND NOT bot) AS cancel_commands, count(*) FILTER (bot) AS bot_messages, count(DISTINCT pr_number) FILTER (contains(coalesce(text, ''), '/vote') AND NOT bot) AS voted_threads, count(DISTINCT author) FILTER (pr_number IS NOT NULL AND NOT bot) AS participants FROM e GROUP BY 1"""
)
def voting_stats(spark, sf_dir):
    """Approvals, automatic merges, commands and participants of each case; a command to cancel is counted as such."""
    return profiles.voting_stats(records(spark, sf_dir), "_case", "eip-review-bot")


_PRESENT = "CASE WHEN CAST({c} AS VARCHAR) NOT IN ('', '0') THEN CAST({c} AS VARCHAR) END"
_UID = "coalesce(" + ", ".join(_PRESENT.format(c=c) for c in ("post_id", "comment_id", "issue_number", "pr_number")) + ")"


@query(
    f"""WITH {REC} SELECT _pos, concat_ws('_', coalesce(_case, 'None'), coalesce(source, 'None'), coalesce({_UID}, 'None'), coalesce(date, 'None')) AS v1,
  CASE WHEN trim(url) <> '' THEN trim(url) ELSE concat_ws('_', _case, coalesce(source, '?'), coalesce({_UID}, sha256(coalesce(text, '')))) END AS v2, concat_ws('_', _case, source, coalesce({_PRESENT.format(c='post_id')}, {_PRESENT.format(c='comment_id')}, 'None')) AS v3,
  'gitvote|pr' || coalesce(pr_number, 0) || '|' || record_type || '|' || _pos AS v4 FROM rec"""
)
def ids(spark, sf_dir):
    """The four ways to name a record."""
    r = records(spark, sf_dir)
    uid = [F.col(c) for c in ("post_id", "comment_id", "issue_number", "pr_number")]
    return r.select(
        "_pos", names.record_id(F.col("_case"), F.col("source"), uid, F.col("date")).alias("v1"), names.url_or_composite_id(F.col("url"), F.col("_case"), F.col("source"), uid, F.col("text")).alias("v2"),
        names.post_or_comment_id(F.col("_case"), F.col("source"), F.col("post_id"), F.col("comment_id")).alias("v3"), names.vote_record_id(F.coalesce("pr_number", F.lit(0)), F.col("record_type"), F.col("_pos")).alias("v4"),
    )


@query(
    f"""WITH {REC} SELECT CASE WHEN source IN ('issue', 'issue_comment') THEN 'issues' WHEN source IN ('pr', 'pr_body', 'pr_review_comment', 'review', 'review_comment') THEN 'prs' WHEN source IN ('discussion', 'discussion_comment', 'discussion_reply') THEN 'discussions' ELSE 'other' END AS source_group,
  CASE WHEN source = 'forum' THEN 'https://forum.example.org/p/' || post_id ELSE coalesce(url, '') END AS link, CASE WHEN lower(author) LIKE 'git%' OR contains(lower(author), 'review') THEN 'bots' ELSE 'people' END AS kind, _pos FROM rec"""
)
def source_groups(spark, sf_dir):
    """The group of each source, the link of each record, and a case told from an id."""
    r = records(spark, sf_dir)
    return r.select(names.source_group(F.col("source")).alias("source_group"), names.record_url(F.col("source"), F.col("post_id"), F.col("url"), "https://forum.example.org/p").alias("link"), names.case_of(F.col("author"), ["git"], ["review"], "bots", "people").alias("kind"), "_pos")


PALETTE = [("Brand#1", "red"), ("Brand#23", "green"), ("brand#3", "blue"), ("MFGR", "none")]


@query(
    """SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'red' WHEN p_brand = 'Brand#23' THEN 'green' WHEN contains(lower(p_brand), 'brand#1') OR contains('brand#1', lower(p_brand)) THEN 'red' WHEN contains(lower(p_brand), 'brand#23') OR contains('brand#23', lower(p_brand)) THEN 'green' WHEN contains(lower(p_brand), 'brand#3') OR contains('brand#3', lower(p_brand)) THEN 'blue' ELSE 'grey' END AS colour,
  CASE WHEN length(p_type) > 12 THEN substr(p_type, 1, 11) || '…' ELSE p_type END AS label, CAST(greatest(10, least(60, 8 + p_size // 5)) AS INTEGER) AS size, CAST(greatest(10, least(50, 8 + p_size * 2)) AS INTEGER) AS small_size, round(greatest(1, least(8, 1 + log2(p_size + 1))), 6) AS width,
  round(greatest(1.5, least(12, 1.5 + 10.5 * log2(p_size + 1) / log2((SELECT max(p_size) FROM part) + 1))), 6) AS share_width FROM part"""
)
def label_rules(spark, sf_dir):
    """Colour from a palette, clipped label, node sizes and edge widths."""
    from plenum.functions import numbers

    p = table(spark, sf_dir, "part")
    most = p.agg(F.max("p_size").alias("most"))
    return p.crossJoin(F.broadcast(most)).select(  # one row
        "p_partkey", names.colour(F.col("p_brand"), PALETTE[:3], "grey").alias("colour"), names.clipped(F.col("p_type"), 12).alias("label"), numbers.node_size(F.col("p_size")).alias("size"),
        F.greatest(F.lit(10), F.least(F.lit(50), 8 + F.col("p_size") * 2)).cast("int").alias("small_size"), F.round(numbers.edge_width(F.col("p_size")), 6).alias("width"), F.round(numbers.share_width(F.col("p_size"), F.col("most")), 6).alias("share_width"),
    )


_ELIGIBLE = "length(trim(coalesce(text, ''))) >= 10 AND NOT (author = 'git-vote[bot]')"


@query(
    f"""WITH {REC}, a AS (SELECT concat_ws('_', source, _pos) AS id, * FROM rec), an AS (SELECT id, annotation_error IS NULL AS good FROM a WHERE _pos % 29 <> 3)
  SELECT source, count(*) AS n, count(*) FILTER ({_ELIGIBLE}) AS eligible, count(*) FILTER (good AND {_ELIGIBLE}) AS ok, count(*) FILTER (NOT good AND {_ELIGIBLE}) AS failed, count(*) FILTER (good IS NULL AND {_ELIGIBLE}) AS missing,
  CASE WHEN count(*) FILTER (good IS NULL AND {_ELIGIBLE}) > 0 THEN 'FAIL' WHEN count(*) FILTER (NOT good AND {_ELIGIBLE}) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM a LEFT JOIN an USING (id) GROUP BY 1"""
)
def coverage_report(spark, sf_dir):
    """Eligible, annotated, failed and missing records of each source, and the verdict."""
    r = records(spark, sf_dir).withColumn("record_id", F.concat_ws("_", "source", "_pos"))
    return profiles.coverage_by(r, r.filter("_pos % 29 <> 3").select("record_id", "annotation_error"), "source", "record_id", predicates.long_enough(F.col("text"), 10) & (F.col("author") != "git-vote[bot]"))


@query(
    f"""WITH {REC}, a AS (SELECT author, date, arg_min(annotation_error IS NULL, _pos) AS good FROM rec WHERE source <> 'forum' GROUP BY 1, 2)
  SELECT record_type, count(*) AS n, count(*) FILTER (good) AS ok, count(*) FILTER (NOT good) AS failed, count(*) FILTER (good IS NULL) AS missing FROM rec LEFT JOIN a USING (author, date) GROUP BY 1"""
)
def vote_coverage(spark, sf_dir):
    """Vote records met with annotated ones by author and date; of several the first counts."""
    r = records(spark, sf_dir)
    return profiles.coverage_by_author(r, r.filter("source <> 'forum'"), "record_type")


@query(
    f"""WITH {REC} SELECT source, CASE WHEN annotation_error IS NULL THEN 'ok' WHEN annotation_error = 'text_too_short' THEN 'short' ELSE 'failed' END AS outcome, CASE WHEN annotation_error <> 'text_too_short' THEN trim(split_part(annotation_error, ':', 1)) END AS error_type, count(*) AS n FROM rec GROUP BY 1, 2, 3"""
)
def annotation_errors(spark, sf_dir):
    """Annotated, short and failed records by source and type of error."""
    return profiles.error_summary(records(spark, sf_dir), "source")


@query(f"WITH {REC}, d AS (SELECT _pos, annotation_error FROM rec WHERE _pos % 4 > 0) SELECT _pos, source FROM rec WHERE _pos NOT IN (SELECT _pos FROM d WHERE annotation_error IS NULL)")
def resume_antijoin(spark, sf_dir):
    """Records that a stage has still to do: new ones, and those that failed."""
    r = records(spark, sf_dir)
    done = r.filter("_pos % 4 > 0").select(F.col("_pos").cast("string").alias("record_id"), "annotation_error")
    return annotate.pending(r, "_pos", done).select("_pos", "source")


@query(f"WITH {REC} SELECT author, coalesce(date, '') AS date, coalesce(record_type, '') AS type, substr(coalesce(text, ''), 1, 40) AS text FROM rec WHERE author NOT IN ('git-vote[bot]', 'eip-review-bot') AND length(trim(coalesce(text, ''))) >= 30")
def substantive_comments(spark, sf_dir):
    return profiles.substantive(records(spark, sf_dir), ["git-vote[bot]", "eip-review-bot"], shown=40)


@query(
    f"""WITH {REC} SELECT _pos, coalesce('pr_' || pr_number, 'issue_' || issue_number, 'pr_' || nullif(regexp_extract(url, '/pulls/([0-9]+)', 1), ''), 'issue_' || nullif(regexp_extract(url, '/issues/([0-9]+)', 1), '')) AS thread,
  coalesce('thread_' || pr_number, 'thread_' || issue_number, 'thread_' || nullif(regexp_extract(url, '/pulls/([0-9]+)', 1), ''), 'thread_' || nullif(regexp_extract(url, '/issues/([0-9]+)', 1), '')) AS merged FROM rec"""
)
def url_thread_key(spark, sf_dir):
    """The thread of each record, from its numbers or else its links."""
    r = records(spark, sf_dir)
    key = lambda merge: text.thread_key(F.col("pr_number"), F.col("issue_number"), [F.col("url")], merge)
    return r.select("_pos", key(False).alias("thread"), key(True).alias("merged"))


@query(
    rf"""WITH {REC}, q AS (SELECT _pos, CASE _pos % 6 WHEN 0 THEN '**@' || institution || '** (R&D)' WHEN 1 THEN '—' WHEN 2 THEN '@@' || author || '/ @alt' || _pos || ' / -' WHEN 3 THEN '`' || state || '`' WHEN 4 THEN '' ELSE '*a* / b' END AS c FROM rec),
  m AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(c, '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'), '`([^`]+)`', '\1', 'g')) AS s FROM q), p AS (SELECT *, list_transform(string_split(s, '/'), lambda x: regexp_replace(trim(x), '^@+', '')) AS parts FROM m)
  SELECT _pos, trim(regexp_replace(regexp_replace(s, '\([^)]*\)', '', 'g'), '^@+', '')) AS institution, CASE WHEN s NOT IN ('—', '-', '') THEN s END AS value, CASE WHEN trim(regexp_replace(s, '^@+', '')) NOT IN ('—', '-', '') THEN trim(regexp_replace(s, '^@+', '')) END AS handle,
  CASE WHEN parts[1] NOT IN ('—', '-', '') THEN parts[1] END AS "primary", array_to_string(list_filter(parts[2:], lambda x: x NOT IN ('—', '-', '')), ',') AS alts FROM p"""
)
def cell_cleaning(spark, sf_dir):
    """Cells of hand-made tables: institutions, values, handles, and handles between slashes."""
    c = records(spark, sf_dir).selectExpr("_pos", "CASE _pos % 6 WHEN 0 THEN '**@' || institution || '** (R&D)' WHEN 1 THEN '—' WHEN 2 THEN '@@' || author || '/ @alt' || _pos || ' / -' WHEN 3 THEN '`' || state || '`' WHEN 4 THEN '' ELSE '*a* / b' END AS c")
    h = text.handles(F.col("c"))
    return c.select("_pos", text.clean_institution(F.col("c")).alias("institution"), text.or_null(F.col("c")).alias("value"), text.clean_handle(F.col("c")).alias("handle"), h["primary"].alias("primary"), F.array_join(h["alts"], ",").alias("alts"))


@query(
    f"""WITH {REC} SELECT _pos, CASE WHEN _pos % 5 IN (0, 1, 2) THEN stance END AS stance, CASE _pos % 5 WHEN 3 THEN 'json_parse: no json ' || _pos WHEN 4 THEN 'api_error: Timeout: ' || _pos END AS annotation_error FROM rec"""
)
def response_parsing(spark, sf_dir):
    """Answers of a model: bare, fenced and after its reasoning; no JSON; a failed call."""
    body = """'{"argument_type": "Technical", "stance": "' || stance || '"}'"""
    r = records(spark, sf_dir).selectExpr("_pos", f"CASE _pos % 5 WHEN 0 THEN {body} WHEN 1 THEN '```json' || chr(10) || {body} || chr(10) || '```' WHEN 2 THEN '<think>no {{' || chr(10) || '</think>' || {body} WHEN 3 THEN 'no json ' || _pos END AS raw", "CASE WHEN _pos % 5 = 4 THEN 'Timeout: ' || _pos END AS failure")
    return r.select("_pos", text.parse_annotation(F.col("raw"), F.col("failure")).alias("p")).select("_pos", "p.annotation.stance", "p.annotation_error")


@query(
    f"""WITH {ROLL}, c AS (SELECT * FROM (VALUES ('User1', 'MetaMask'), ('User2', 'Google'), ('nobody', 'Google')) AS t(canonical, expected))
  SELECT c.canonical, expected, institution_final, CASE WHEN institution_final IS NULL THEN 'MISSING' WHEN institution_final = expected THEN 'OK' ELSE 'MISMATCH' END AS outcome FROM c LEFT JOIN roll USING (canonical)"""
)
def spot_checks(spark, sf_dir):
    """What known authors came out as, against what they are."""
    return profiles.spot_checks(rolled(spark, sf_dir), {"User1": "MetaMask", "User2": "Google", "nobody": "Google"})


@query(f"WITH {REC} SELECT _pos, source FROM rec ORDER BY _pos LIMIT 25")
def first_records(spark, sf_dir):
    """The first records in the order of the file, as a run with a limit takes them."""
    return annotate.first(records(spark, sf_dir), "_pos", 25).select("_pos", "source")


@query(
    f"""WITH {REC}, s AS (SELECT CASE WHEN _case = 'first' AND source = 'forum' THEN 'first forum' WHEN _case = 'first' THEN 'first other' WHEN source = 'issue_comment' THEN 'second issues' WHEN source = 'pr' THEN 'second prs' END AS stratum FROM rec WHERE annotation_error IS NULL)
  SELECT stratum, least(count(*), CASE stratum WHEN 'first forum' THEN 16 WHEN 'first other' THEN 4 WHEN 'second issues' THEN 17 ELSE 9 END) AS n, least(count(*), CASE stratum WHEN 'first forum' THEN 16 WHEN 'first other' THEN 4 WHEN 'second issues' THEN 17 ELSE 9 END) AS n_distinct, true AS all_of_it FROM s WHERE stratum IS NOT NULL GROUP BY 1"""
)
def stratified_sample(spark, sf_dir):
    """A seeded sample without replacement of a size of its own from each stratum; checked against the records it was drawn from."""
    stratum = "CASE WHEN _case = 'first' AND source = 'forum' THEN 'first forum' WHEN _case = 'first' THEN 'first other' WHEN source = 'issue_comment' THEN 'second issues' WHEN source = 'pr' THEN 'second prs' END"
    r = records(spark, sf_dir).filter("annotation_error is null").withColumn("stratum", F.expr(stratum))
    s = annotate.stratified_sample(r, "stratum", {"first forum": 16, "first other": 4, "second issues": 17, "second prs": 9}, "_pos", seed=42)
    own = s.join(r.select(F.col("_pos"), F.col("stratum").alias("own")), "_pos")
    return own.groupBy("stratum").agg(F.count("*").alias("n"), F.count_distinct("_pos").alias("n_distinct"), F.bool_and(F.col("stratum") == F.col("own")).alias("all_of_it"))
