"""Records of communities: schemas, mappers from landed API items to flat records, nested threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.predicates import is_bot, strip

#: The superset of record fields. Ids that change type between sources are text; dates are ISO-8601 text.
RECORD = (
    "source string, platform string, record_type string, post_id bigint, post_number int, pr_number int, issue_number int, discussion_number int, comment_id string, parent_comment_id string, sha string, "
    "date string, closed_at string, merged_at string, author string, author_display string, title string, raw_text string, own_text string, state string, merged boolean, labels array<string>, "
    "url string, issue_url string, pr_url string, reply_to_post_number int, quoted_post_numbers array<int>, reply_count int, quote_count int, like_count int"
)

PROFILE = "handle string, found boolean, name string, bio string, company string, location string, website string, groups array<string>"

API_ITEM = (
    "id string, number int, sha string, html_url string, issue_url string, pull_request_url string, title string, body string, state string, created_at string, closed_at string, merged_at string, submitted_at string, "
    "user struct<login:string>, labels array<struct<name:string>>, commit struct<message:string,author:struct<name:string,date:string>>, author struct<login:string>"
)


def commits(items: DataFrame, platform: str) -> DataFrame:
    return items.select(F.lit("commit").alias("source"), F.lit(platform).alias("platform"), F.substring("sha", 1, 10).alias("sha"), F.col("commit.author.date").alias("date"), F.coalesce("author.login", "commit.author.name").alias("author"), F.col("commit.message").alias("raw_text"), F.col("html_url").alias("url"))


def _issue(platform: str, source: str, number: str) -> list[Column]:
    return [
        F.lit(source).alias("source"), F.lit(platform).alias("platform"), F.col("number").alias(number), F.col("created_at").alias("date"), F.col("closed_at"), F.col("user.login").alias("author"), F.col("title"),
        F.coalesce("body", F.lit("")).alias("raw_text"), F.col("state"), F.transform("labels", lambda x: x["name"]).alias("labels"), F.col("html_url").alias("url"),
    ]


def issues(items: DataFrame, platform: str) -> DataFrame:
    return items.select(*_issue(platform, "issue", "issue_number"))


def pulls(items: DataFrame, platform: str) -> DataFrame:
    return items.select(*_issue(platform, "pr", "pr_number"), "merged_at", F.col("merged_at").isNotNull().alias("merged"))


def comments(items: DataFrame, platform: str, source: str = "issue_comment") -> DataFrame:
    return items.select(
        F.lit(source).alias("source"), F.lit(platform).alias("platform"), F.col("id").alias("comment_id"), F.coalesce("submitted_at", "created_at").alias("date"), F.col("user.login").alias("author"),
        F.coalesce("body", F.lit("")).alias("raw_text"), "state", "issue_url", F.col("pull_request_url").alias("pr_url"), F.col("html_url").alias("url"),
    )


DISCUSSION = (
    "number int, title string, body string, createdAt string, url string, upvoteCount int, author struct<login:string>, category struct<name:string>, "
    "comments array<struct<id:string,body:string,createdAt:string,url:string,upvoteCount:int,author:struct<login:string>,replies:array<struct<id:string,body:string,createdAt:string,url:string,upvoteCount:int,author:struct<login:string>>>>>"
)


def flatten_discussions(nested: DataFrame) -> DataFrame:
    """Discussions, their comments and the replies to these, as flat records."""
    common = lambda x: [F.col(f"{x}.author.login").alias("author"), F.col(f"{x}.createdAt").alias("date"), F.coalesce(f"{x}.body", F.lit("")).alias("raw_text"), F.col(f"{x}.url").alias("url"), F.col(f"{x}.upvoteCount").alias("upvote_count")]
    d = nested.select(F.struct("*").alias("d"))
    head = [F.col("d.number").alias("discussion_number"), F.col("d.title").alias("discussion_title"), F.col("d.category.name").alias("discussion_category")]
    none = F.lit(None).cast("string")
    c = d.select("d", F.explode("d.comments").alias("c"))
    r = c.select("d", "c", F.explode("c.replies").alias("r"))
    return (
        d.select(F.lit("discussion").alias("source"), *head, none.alias("comment_id"), none.alias("parent_comment_id"), *common("d"))
        .unionByName(c.select(F.lit("discussion_comment").alias("source"), *head, F.col("c.id").alias("comment_id"), none.alias("parent_comment_id"), *common("c")))
        .unionByName(r.select(F.lit("discussion_reply").alias("source"), *head, F.col("r.id").alias("comment_id"), F.col("c.id").alias("parent_comment_id"), *common("r")))
    )


REPOSITORY = "full_name string, description string, created_at string, updated_at string, stargazers_count int, forks_count int, open_issues_count int, default_branch string, license struct<spdx_id:string>, html_url string"


def repository(item: DataFrame) -> DataFrame:
    """The one row of a repository's metadata."""
    return item.select(
        "full_name", "description", "created_at", "updated_at", F.col("stargazers_count").alias("stars"), F.col("forks_count").alias("forks"), F.col("open_issues_count").alias("open_issues"),
        "default_branch", F.col("license.spdx_id").alias("license"), F.col("html_url").alias("url"),
    )


def lookup_profiles(handles: DataFrame, handle: str, profiles: DataFrame) -> DataFrame:
    """A profile for each distinct handle; found is false where there is none."""
    h = handles.select(F.col(handle).alias("handle")).filter(F.col("handle").isNotNull()).distinct()
    return h.join(profiles.drop("found").withColumn("_hit", F.lit(True)), "handle", "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def load_corpus(records: DataFrame, cases: list[str], bots: list[str], least: int = 20, id_col: str = "record_id") -> DataFrame:
    """record id, case, author, date and text of the records that a topic model reads: of the cases, by people, and long enough."""
    t = strip(F.coalesce("raw_text", F.lit("")))
    kept = records.filter(F.col("_case").isin(cases) & ~is_bot(F.coalesce("author", F.lit("")), set(bots), ["[bot]"]) & (F.length(t) >= least))
    return kept.select(F.col(id_col), "_case", "author", "date", t.alias("text"))
