"""Author profiles from records: roll-up, affiliation by provenance, roles, core selection, votes and lifecycles.

Records have: author, source, _case, date, annotation, pr_number, issue_number and _pos (the order of ingest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.predicates import contains_name, strip
from plenum.operators.identity import CONFIDENCE_RANK, SOURCE_RANK, majority, rank  # noqa: F401

# Names of roles, of a proposal's stages and of a vote's events, and the bot that counts votes.
ROLES = ["Proposer", "Core Developer", "Reviewer", "Community Voice", "Occasional Contributor"]
STAGES = ["PR Submitted", "Auto-merge (bot)", "EIP Editor Approved", "Review Comment"]
EVENTS = ["PR Opened", "/cancel-vote issued", "/vote issued", "Vote opened (bot)", "Vote closed (bot)", "Merged"]
OUTCOMES = ["PASSED", "CLOSED/REJECTED"]
VOTE_BOT = "git-vote[bot]"

CORE_RULES = {"first": "case_records >= 3 or case_threads >= 2", "second": "case_records >= 50"}


def rollup(records: DataFrame, affiliations: DataFrame) -> DataFrame:
    """One row for each canonical author: cases, records, threads, count maps and the affiliation with its source.

    affiliations: canonical, institution, source (from profiles). Without one the majority of the annotations
    counts, else Unknown.
    """
    thread = F.when(F.col("pr_number").isNotNull(), F.concat(F.lit("PR#"), "pr_number")).when(F.col("issue_number").isNotNull(), F.concat(F.lit("I#"), "issue_number"))
    base = records.groupBy("canonical").agg(F.count("*").alias("total_records"), F.sort_array(F.collect_set(F.coalesce("_case", F.lit("")))).alias("cases"), F.sort_array(F.collect_set(thread)).alias("threads_touched"))
    said = records.select("canonical", "_pos", F.col("annotation.stakeholder_institution").alias("institution_lm"), F.col("annotation.argument_type").alias("argument"), F.col("annotation.stance").alias("stance"))
    lm = majority(said.filter("institution_lm <> ''"), "canonical", "institution_lm", "_pos")
    out = base.join(lm, "canonical", "left")
    for label, name in (("argument", "argument_types"), ("stance", "stances")):
        n = said.filter(F.col(label) != "").groupBy("canonical", label).agg(F.count("*").alias("n"))
        out = out.join(n.groupBy("canonical").agg(F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias(name)), "canonical", "left")  # closed vocabularies
    out = out.withColumn("institution_lm", F.coalesce("institution_lm", F.lit("Unknown")))
    a = affiliations.select("canonical", F.col("institution").alias("_i"), F.col("source").alias("_s"))
    out = out.join(a, "canonical", "left")
    return out.withColumn("institution_final", F.coalesce("_i", "institution_lm")).withColumn("institution_source", F.when(F.col("_i").isNotNull(), F.col("_s")).otherwise("lm_inferred")).drop("_i", "_s")


def merge_manual(profiles: DataFrame, manual: DataFrame) -> DataFrame:
    """profiles with what was looked up by hand (canonical, institution, source, confidence): promoted if its source ranks at least as high. The model's label stays."""
    m = manual.select("canonical", F.col("institution").alias("institution_manual"), F.col("source").alias("_ms"), F.col("confidence").alias("_mc"))
    j = profiles.join(m, "canonical", "left")
    wins = F.col("institution_manual").isNotNull() & (rank(F.col("_ms"), SOURCE_RANK) >= rank(F.coalesce("institution_source", F.lit("lm_inferred")), SOURCE_RANK))
    default = F.when(F.col("institution_manual").isNotNull(), "LM_inferred").when(F.col("institution_source") == "github_company_field", "Strong").when(F.col("institution_source").isin("github_bio", "forum_bio"), "Probable").otherwise("LM_inferred")
    return (
        j.withColumn("institution_confidence", F.when(wins, F.col("_mc")).otherwise(default))
        .withColumn("institution_final", F.when(wins, F.col("institution_manual")).otherwise(F.col("institution_final")))
        .withColumn("institution_source", F.when(wins, F.col("_ms")).otherwise(F.col("institution_source")))
        .drop("_ms", "_mc")
    )


def add_missing(profiles: DataFrame, authors: DataFrame) -> DataFrame:
    """profiles and a row for each author (canonical, ...) that has none."""
    return profiles.unionByName(authors.join(profiles.select("canonical"), "canonical", "left_anti"), allowMissingColumns=True)


def roles(profiles: DataFrame, records: DataFrame) -> DataFrame:
    """canonical and role, by the first rule that holds."""
    has = lambda *s: F.count_if(F.col("source").isin(*s))
    n = records.groupBy("canonical").agg(has("github_pr_body", "pr").alias("_pr"), has("forum").alias("_forum"), has("github_review", "review_comment").alias("_review"), has("commit").alias("_commit"))
    p = profiles.join(n, "canonical", "left")
    of = lambda m, k: F.coalesce(F.element_at(m, F.lit(k)), F.lit(0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = zero("total_records")
    proposer = ((zero("_pr") > 0) | (zero("_forum") > 3)) & (of("stances", "Support") > of("stances", "Oppose"))
    implementer = (zero("_commit") > 0) | (of("argument_types", "Technical") > total * 0.5)
    reviewer = (zero("_review") > 0) | (of("argument_types", "Process") > 0)
    role = F.when(proposer & (total >= 3), ROLES[0]).when(implementer & (total >= 5), ROLES[1]).when(reviewer, ROLES[2]).when(total >= 5, ROLES[3]).otherwise(ROLES[4])
    return p.select("canonical", role.alias("role"))


def core(records: DataFrame, rules: dict[str, str] = CORE_RULES) -> DataFrame:
    """case, canonical, case_records, case_threads and forum_posts of those whom their case's rule selects. Each record counts once, whatever handles its author has."""
    n = records.groupBy("_case", "canonical").agg(F.count("*").alias("case_records"), F.countDistinct("pr_number").alias("case_threads"), F.count_if(F.col("source") == "forum").alias("forum_posts"))
    keep = F.lit(False)
    for case, rule in rules.items():
        keep = keep | ((F.col("_case") == case) & F.expr(rule))
    return n.filter(keep).withColumnRenamed("_case", "case")


def in_both(profiles: DataFrame, a: str, b: str) -> DataFrame:
    """Profiles with records of both cases, the most active first."""
    return profiles.filter(F.array_contains("cases", a) & F.array_contains("cases", b)).orderBy(F.desc("total_records"), "canonical")


def _day() -> Column:
    return F.coalesce(F.substring("date", 1, 10), F.lit(""))


def proposal_lifecycle(records: DataFrame, merge_bot: str) -> DataFrame:
    """date, stage and author of a proposal's stages."""
    approved = (F.col("source") == "github_review") & (F.col("state") == "APPROVED")
    stage = (
        F.when(F.col("source") == "github_pr_body", STAGES[0])
        .when(approved & contains_name(F.col("author"), merge_bot), STAGES[1])
        .when(approved, STAGES[2])
        .when(F.col("source") == "github_review_comment", STAGES[3])
    )
    return records.select(_day().alias("date"), stage.alias("stage"), "author").filter("stage is not null")


def vote_lifecycle(records: DataFrame) -> DataFrame:
    """pr_number, date, event and author of a vote's events. A cancellation is told by its own command."""
    text, bot = F.coalesce("text", F.lit("")), contains_name(F.col("author"), "bot")
    comment, low = F.col("record_type") == "issue_comment", F.lower(F.coalesce("text", F.lit("")))
    event = (
        F.when(F.col("record_type") == "pr_body", EVENTS[0])
        .when(comment & ~bot & text.contains("/cancel-vote"), EVENTS[1])
        .when(comment & ~bot & text.contains("/vote"), EVENTS[2])
        .when(comment & bot & low.contains("vote created"), EVENTS[3])
        .when(comment & bot & (low.contains("vote closed") | low.contains("passed")), EVENTS[4])
        .when((F.col("record_type") == "review") & (F.col("state") == "APPROVED"), EVENTS[5])
    )
    who = F.when(comment & bot, VOTE_BOT).otherwise(F.col("author"))
    return records.select("pr_number", _day().alias("date"), event.alias("event"), who.alias("author")).filter("event is not null")


def vote_results(records: DataFrame, bot: str = VOTE_BOT) -> DataFrame:
    """For each pull request: the last status, the distinct voters for and against, the bot's log lines and the commands."""
    text, own = F.coalesce("text", F.lit("")), F.col("author") == bot
    low = F.lower(text)
    status = F.when(own & low.contains("passed"), OUTCOMES[0]).when(own & low.contains("closed"), OUTCOMES[1])
    each = records.select(
        "pr_number", "_pos", status.alias("s"), (own & text.rlike("Vote (status|created|closed)")).alias("log"), ((F.col("record_type") == "issue_comment") & (strip(text) == "/vote")).alias("command"),
        F.when(own, F.regexp_extract_all(text, F.lit(r":white_check_mark:[^\n]*@(\w[\w-]*)"), 1)).alias("yes"), F.when(own, F.regexp_extract_all(text, F.lit(r":x:[^\n]*@(\w[\w-]*)"), 1)).alias("no"),
    )
    names = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  the voters of one request
    return each.groupBy("pr_number").agg(
        F.coalesce(F.max_by("s", F.when(F.col("s").isNotNull(), F.col("_pos"))), F.lit("")).alias("final_status"), names("yes").alias("in_favour"), names("no").alias("against"), F.count_if("log").alias("bot_log"), F.count_if("command").alias("vote_triggers"),
    )


def voting_stats(records: DataFrame, by: str, merge_bot: str) -> DataFrame:
    """For each value of by: approvals by people and by the merge bot, commands to vote and to cancel, the bots' messages, the threads voted on and those who took part."""
    t, bot, merger = F.coalesce("text", F.lit("")), contains_name(F.col("author"), "bot"), contains_name(F.col("author"), merge_bot)
    approved = (F.col("source") == "github_review") & (F.col("state") == "APPROVED") & ~merger
    command = t.contains("/vote") & ~bot
    return records.groupBy(by).agg(
        F.count_if(approved).alias("human_approvals"), F.count_distinct(F.when(approved, F.col("author"))).alias("approvers"), F.count_if((F.col("source") == "github_review") & merger).alias("bot_auto_merges"),
        F.count_if(command).alias("vote_commands"), F.count_if(t.contains("/cancel-vote") & ~bot).alias("cancel_commands"), F.count_if(bot).alias("bot_messages"),
        F.count_distinct(F.when(command, F.col("pr_number"))).alias("voted_threads"), F.count_distinct(F.when(F.col("pr_number").isNotNull() & ~bot, F.col("author"))).alias("participants"),
    )


def substantive(records: DataFrame, bots: list[str], least: int = 30, shown: int = 600) -> DataFrame:
    """author, date, type and the beginning of the text of comments by people."""
    t = F.coalesce("text", F.lit(""))
    kept = records.filter(~F.coalesce(F.col("author").isin(bots), F.lit(False)) & (F.length(strip(t)) >= least))
    return kept.select("author", F.coalesce("date", F.lit("")).alias("date"), F.coalesce("record_type", F.lit("")).alias("type"), F.substring(t, 1, shown).alias("text"))


def coverage(raw: DataFrame, annotated: DataFrame, key: str = "record_id") -> DataFrame:
    """One row: records, annotated, failed and missing ones, and the verdict."""
    a = annotated.groupBy(key).agg(F.max(F.when(F.col("annotation_error").isNull(), 1).otherwise(0)).alias("_ok"))
    j = raw.select(key).distinct().join(a, key, "left")
    n, ok = F.count("*"), F.count_if(F.col("_ok") == 1)
    failed, missing = F.count_if(F.col("_ok") == 0), F.count_if(F.col("_ok").isNull())
    return j.agg(n.alias("n"), ok.alias("ok"), failed.alias("failed"), missing.alias("missing"), F.when(missing > 0, "FAIL").when(failed > 0, "WARN").otherwise("PASS").alias("verdict"))


def coverage_by(raw: DataFrame, annotated: DataFrame, by: str, key: str, eligible: Column) -> DataFrame:
    """For each value of by: all and eligible records, those annotated, failed and missing among the eligible ones, and the verdict."""
    a = annotated.groupBy(F.col(key).alias("_key")).agg(F.max(F.col("annotation_error").isNull().cast("int")).alias("_ok"))
    j = raw.withColumn("_eligible", F.coalesce(eligible, F.lit(False))).join(a, F.col(key) == F.col("_key"), "left")
    ok, failed, missing = (F.count_if(F.col("_eligible") & c) for c in (F.col("_ok") == 1, F.col("_ok") == 0, F.col("_ok").isNull()))
    return j.groupBy(by).agg(F.count("*").alias("n"), F.count_if("_eligible").alias("eligible"), ok.alias("ok"), failed.alias("failed"), missing.alias("missing"), F.when(missing > 0, "FAIL").when(failed > 0, "WARN").otherwise("PASS").alias("verdict"))


def coverage_by_author(raw: DataFrame, annotated: DataFrame, by: str) -> DataFrame:
    """For each value of by: records, and those annotated, failed and missing, where records of one author and date are the same and the first annotated one counts."""
    a = annotated.groupBy("author", "date").agg(F.min_by(F.col("annotation_error").isNull(), "_pos").alias("_ok"))
    j = raw.join(a, ["author", "date"], "left")
    return j.groupBy(by).agg(F.count("*").alias("n"), F.count_if("_ok").alias("ok"), F.count_if(~F.col("_ok")).alias("failed"), F.count_if(F.col("_ok").isNull()).alias("missing"))


def error_summary(annotated: DataFrame, by: str, short: str = "text_too_short") -> DataFrame:
    """by, outcome (ok, short or failed), error_type (what stands before the colon) and n."""
    e = F.col("annotation_error")
    outcome = F.when(e.isNull(), "ok").when(e == short, "short").otherwise("failed")
    return annotated.groupBy(by, outcome.alias("outcome"), F.when(outcome == "failed", strip(F.get(F.split(e, ":"), 0))).alias("error_type")).agg(F.count("*").alias("n"))


def spot_checks(profiles: DataFrame, expected: dict[str, str]) -> DataFrame:
    """canonical, expected, institution_final and outcome (OK, MISMATCH or MISSING) of known authors."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("canonical"), F.lit(v).alias("expected")) for k, v in expected.items()]))
    wanted = profiles.sparkSession.range(1).select(pairs.alias("p")).select("p.*")
    j = wanted.join(profiles.select("canonical", "institution_final"), "canonical", "left")
    return j.withColumn("outcome", F.when(F.col("institution_final").isNull(), "MISSING").when(F.col("institution_final") == F.col("expected"), "OK").otherwise("MISMATCH"))


def require_coverage(report: DataFrame) -> None:
    """Raises unless the one-row report says PASS or WARN."""
    r = report.first()
    if r["verdict"] == "FAIL":
        raise ValueError(f"{r['missing']} of {r['n']} records have no annotation")


def summary_row(profiles: DataFrame) -> DataFrame:
    """Flat rows for CSV: maps as k:v lists, the first threads, the beginning of the bio."""
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), "; ")
    return profiles.select(
        "canonical", "institution_final", "institution_source", "total_records", F.coalesce(text("argument_types"), F.lit("")).alias("argument_types_summary"), F.coalesce(text("stances"), F.lit("")).alias("stances_summary"),
        F.array_join(F.slice("threads_touched", 1, 10), "; ").alias("threads_touched"), F.substring(F.coalesce("bio", F.lit("")), 1, 100).alias("bio_snippet") if "bio" in profiles.columns else F.lit("").alias("bio_snippet"),
    )
