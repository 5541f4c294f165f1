"""Record ids, classes of sources, links, colours and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions.predicates import strip, truthy


def present(c: Column) -> Column:
    """The value as text; null where it is missing, empty or zero."""
    t = c.cast("string")
    return F.when(~t.isin("", "0"), t)


def first_present(*values: Column) -> Column:
    return F.coalesce(*[present(v) for v in values])


def record_id(case: Column, source: Column, uid: list[Column], date: Column) -> Column:
    """case_source_uid_date; missing parts read None."""
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in (case, source, first_present(*uid), date)]
    return F.concat_ws("_", *parts)


def url_or_composite_id(url: Column, case: Column, source: Column, uid: list[Column], text: Column) -> Column:
    """The url, or case_source_uid; without a uid, the text's SHA-256 stands for it, the same in every process."""
    own = F.coalesce(first_present(*uid), F.sha2(F.coalesce(text, F.lit("")), 256))
    return F.coalesce(truthy(strip(url)), F.concat_ws("_", case, F.coalesce(source, F.lit("?")), own))


def post_or_comment_id(case: Column, source: Column, post: Column, comment: Column) -> Column:
    """case_source_id from a post's or else a comment's id: not one for each record, as others have neither."""
    return F.concat_ws("_", case, source, F.coalesce(first_present(post, comment), F.lit("None")))


def vote_record_id(pr: Column, kind: Column, uid: Column) -> Column:
    return F.concat_ws("|", F.lit("gitvote"), F.concat(F.lit("pr"), pr.cast("string")), kind, uid.cast("string"))


def source_group(source: Column) -> Column:
    """issues, prs, discussions or other."""
    return (
        F.when(source.isin("issue", "issue_comment"), "issues")
        .when(source.isin("pr", "pr_body", "pr_review_comment", "review", "review_comment"), "prs")
        .when(source.isin("discussion", "discussion_comment", "discussion_reply"), "discussions")
        .otherwise("other")
    )


def record_url(source: Column, post: Column, url: Column, forum: str) -> Column:
    """A forum post's link from its number; else the record's own, or empty."""
    return F.when(source == "forum", F.concat(F.lit(forum.rstrip("/") + "/"), post.cast("string"))).otherwise(F.coalesce(url, F.lit("")))


def case_of(record: Column, prefixes: list[str], parts: list[str], case: str, other: str) -> Column:
    """case if an id starts with a prefix or has a part, in lower case."""
    low = F.lower(record)
    found = F.lit(False)
    for p in prefixes:
        found = found | low.startswith(p)
    for p in parts:
        found = found | low.contains(p)
    return F.when(found, case).otherwise(other)


def colour(name: Column, palette: list[tuple[str, str]], default: str, both_ways: bool = True) -> Column:
    """The palette's entry of that name; else the first whose name holds the other's; else the default."""
    out = F.lit(default)
    for key, c in reversed(palette):
        near = F.lower(name).contains(key.lower())
        if both_ways:
            near = near | F.lit(key.lower()).contains(F.lower(name))
        out = F.when(near, c).otherwise(out)
    for key, c in reversed(palette):
        out = F.when(name == key, c).otherwise(out)
    return out


def clipped(label: Column, most: int = 24) -> Column:
    """A label of at most so many characters, the last a mark where it was cut."""
    return F.when(F.length(label) > most, F.concat(F.substring(label, 1, most - 1), F.lit("…"))).otherwise(label)
