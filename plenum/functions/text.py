"""Scalar functions on text: identities, links, marks, and what models return."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from plenum.functions.predicates import strip

# Patterns of institutions and their labels, in the order in which they are tried.
INSTITUTIONS = [
    (r"\bmetamask\b", "MetaMask"),
    (r"\bconsensys\b", "ConsenSys"),
    (r"\bethereumfoundation\b|\bethereum foundation\b|\bef\b|\befdn\b", "Ethereum Foundation"),
    (r"\bgoogle\b", "Google"),
    (r"\bmicrosoft\b", "Microsoft"),
    (r"\bcoinbase\b", "Coinbase"),
    (r"\bopenai\b", "OpenAI"),
    (r"\banthropicl\b|\banthropic\b", "Anthropic"),
    (r"\bprotocol labs\b", "Protocol Labs"),
    (r"\boasis\b", "Oasis"),
    (r"\bgnosisguild\b|\bgnosis guild\b|\bgnosis\b", "Gnosis"),
    (r"\bsafe\b", "Safe"),
    (r"\barkham\b", "Arkham"),
    (r"\bzk ?sync\b|\bmatter labs\b", "Matter Labs"),
    (r"\bstarkware\b", "StarkWare"),
    (r"\boptimism\b", "Optimism"),
    (r"\barbitrum\b|\boffchain labs\b", "Offchain Labs"),
    (r"\bpolygon\b", "Polygon"),
    (r"\bchainlink\b", "Chainlink"),
    (r"\bender labs\b|\bender\b", "Ender Labs"),
    (r"\balchemy\b", "Alchemy"),
    (r"\binfura\b", "Infura"),
    (r"\buniversity\b|\buniv\b|\bcollege\b|\bacademia\b|\bphd\b", "Academia"),
    (r"\bindependent\b|\bfreelance\b|\bself.?employed\b", "Independent"),
]

# Cells that stand for no value.
NO_VALUE = ["未知", "（未公开姓名）", "（未公开）", "—", "-", ""]


def first_pattern(text: Column, patterns: list[tuple[str, str]] = INSTITUTIONS) -> Column:
    """Label of the first pattern found, in any case; null if none is."""
    out = F.lit(None).cast("string")
    for pattern, label in reversed(patterns):
        out = F.when(F.coalesce(text, F.lit("")).rlike("(?iU)" + pattern), label).otherwise(out)
    return out


def with_source(fields: list[tuple[str, Column]], patterns: list[tuple[str, str]] = INSTITUTIONS) -> Column:
    """institution and source from the first field that has a pattern."""
    kind = "struct<institution:string,source:string>"
    found = [F.when(first_pattern(c, patterns).isNotNull(), F.struct(first_pattern(c, patterns).alias("institution"), F.lit(name).alias("source"))) for name, c in fields]
    return F.coalesce(*found, F.lit(None).cast(kind))


def nullable_extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def thread_key(number: Column, issue: Column, urls: list[Column], merge: bool = False) -> Column:
    """pr_N or issue_N, from the numbers or else from the urls. merge: one key for both kinds."""
    pr, iss = ("thread_", "thread_") if merge else ("pr_", "issue_")
    from_url = [F.concat(F.lit(prefix), nullable_extract(u, pattern)) for u in urls for prefix, pattern in ((pr, r"/pulls/(\d+)"), (iss, r"/issues/(\d+)"))]
    return F.coalesce(F.concat(F.lit(pr), number.cast("string")), F.concat(F.lit(iss), issue.cast("string")), *from_url)


def quoted_numbers(html: Column, pattern: str = r'data-post="(\d+)"') -> Column:
    """Numbers of the posts that a post quotes, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), 1))


def strip_markdown(text: Column) -> Column:
    """Without bold, italic and code marks."""
    for pattern in (r"\*\*([^*]+)\*\*", r"\*([^*]+)\*", r"`([^`]+)`"):
        text = F.regexp_replace(text, pattern, "$1")
    return strip(text)


def first_url(text: Column) -> Column:
    """The first link of Markdown, or else the first bare link."""
    bare = F.regexp_replace(nullable_extract(text, r"(https?://[^\s\)）】\]]+)"), r"[）)。]+$", "")
    return F.coalesce(nullable_extract(text, r"\[.*?\]\((https?://[^\)]+)\)"), bare)


def clean_institution(raw: Column) -> Column:
    """Without marks, parentheses and a leading @."""
    t = F.regexp_replace(F.regexp_replace(strip_markdown(raw), "（[^）]*）", ""), r"\([^)]*\)", "")
    return strip(F.regexp_replace(t, "^@+", ""))


def or_null(text: Column) -> Column:
    """A cell's value; null if it stands for none."""
    t = strip_markdown(text)
    return F.when(t.isin(NO_VALUE), None).otherwise(t)


def clean_handle(raw: Column) -> Column:
    t = strip(F.regexp_replace(strip_markdown(raw), "^@+", ""))
    return F.when(t.isin(NO_VALUE), None).otherwise(t)


def handles(cell: Column) -> Column:
    """primary and alts of a cell: handles between slashes."""
    parts = F.transform(F.split(strip_markdown(cell), "/"), lambda p: F.regexp_replace(strip(p), "^@+", ""))
    primary = F.get(parts, 0)
    return F.struct(F.when(primary.isin(NO_VALUE), None).otherwise(primary).alias("primary"), F.filter(F.slice(parts, 2, 1000), lambda p: ~p.isin(NO_VALUE)).alias("alts"))


def clean_response(raw: Column) -> Column:
    """A model's answer without its reasoning block and code fence."""
    t = strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))
    return strip(F.regexp_replace(F.regexp_replace(t, r"(?s)^```[^\n]*\n(.*?)```.*$", "$1"), r"(?s)^```[^\n]*\n", ""))


ANNOTATION = "stakeholder_institution string, argument_type string, stance string, consensus_signal string, key_point string"


def parse_annotation(raw: Column, failure: Column | None = None) -> Column:
    """annotation and annotation_error of an answer: a failed call, or text that is no JSON object, gives an error."""
    t = clean_response(raw)
    valid = F.try_parse_json(t).isNotNull() & t.startswith("{")
    error = F.when(~F.coalesce(valid, F.lit(False)), F.concat(F.lit("json_parse: "), F.substring(F.coalesce(t, F.lit("")), 1, 60)))
    if failure is not None:
        error = F.when(failure.isNotNull(), F.concat(F.lit("api_error: "), F.substring(failure, 1, 120))).otherwise(error)
    return F.struct(F.when(error.isNull(), F.from_json(t, ANNOTATION)).alias("annotation"), error.alias("annotation_error"))


class _Text(HTMLParser):
    """Text nodes, with and without quotes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.all: list[str] = []
        self.own: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        if tag == "aside" and (self.depth or "quote" in (dict(attrs).get("class") or "").split()):
            self.depth += 1

    def handle_endtag(self, tag):
        if tag == "aside" and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        self.all.append(data)
        if not self.depth:
            self.own.append(data)


#: An ampersand and, if one follows, what looks like a whole character reference.
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?")


def html_text(html: Column, ended: bool = False) -> Column:
    """raw_text and own_text: a post's text nodes joined by spaces, and those outside quotes.

    ended: only references that a semicolon ends are decoded, where HTML also decodes some without it (&amp).
    """

    @pandas_udf("raw_text string, own_text string")
    def parse(s: pd.Series) -> pd.DataFrame:
        out = []
        for h in s:
            h, p = h or "", _Text()
            held = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in h)  # stands for other ampersands while the page is parsed
            if ended:
                h = _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else held + (m[1] or ""), h)
            p.feed(h)
            p.close()
            out.append(tuple(" ".join(t).strip().replace(held, "&") for t in (p.all, p.own)))
        return pd.DataFrame(out, columns=["raw_text", "own_text"])

    return parse(html)


def _table_rows(text: str) -> list[list[str]]:
    """Cells of the first table's rows, the header first."""
    lines = [line.strip() for line in text.splitlines()]
    start = next((k for k, line in enumerate(lines) if line.startswith("|")), len(lines))
    end = next((k for k in range(start, len(lines)) if not lines[k].startswith("|")), len(lines))
    rows = [[c.strip() for c in line.split("|")[1:-1]] for line in lines[start:end]]
    return [r for r in rows if r and not all(c and not c.strip("-: ") for c in r)]


def _sections(text: str) -> list[tuple[str, str]]:
    """Headings of level two and below with the lines under them; an empty section gives none."""
    found: dict[str, list[str]] = {}
    heading, lines = "__preamble__", []
    for line in [*text.splitlines(), "##"]:
        if line.startswith("##"):
            if lines:
                found[heading] = lines
            heading, lines = line.strip(), []
        else:
            lines.append(line)
    return [(h, "\n".join(b)) for h, b in found.items()]


def markdown_tables(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, heading, row and cells: the first table of each section of each text."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, h, n, cells) for k, t in zip(batch["id"], batch["t"], strict=True) for h, body in _sections(t or "") for n, cells in enumerate(_table_rows(body))]
            yield pd.DataFrame(out, columns=["id", "heading", "row", "cells"])

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).mapInPandas(parse, "id string, heading string, row int, cells array<string>")


# What stands for notes that are missing, or empty.
NO_NOTES, EMPTY_NOTES = "无公开信息", "无公开信息，人工核查后归为Independent"
ENTRY = "primary_handle string, alt_handles array<string>, display_name string, institution string, confidence string, institution_source string, case string, evidence string, evidence_url string, lm_correction boolean, lm_wrong string, section string"


def manual_entries(tables: DataFrame, sections: dict[str, tuple[str, str, str]], header_url: str | None = None) -> DataFrame:
    """Entries from the tables of markdown_tables, as ENTRY. sections: heading to (kind, case, section).

    Kinds are confirmed (handles, name, institution, confidence, evidence), unknown (handle, name, count, notes), corrections
    (handle, what the model said, what holds, evidence) and header (name, handle, e-mail, institution). Rows that lack
    a cell they need, or a handle where one is needed, give none.
    """
    c = [F.get("cells", i) for i in range(5)]
    none, no_alts = F.lit(None).cast("string"), F.array().cast("array<string>")
    has = lambda n: F.size("cells") >= n
    linked = lambda x: strip(F.regexp_replace(strip_markdown(x), r"\[([^\]]+)\]\([^\)]+\)", "$1"))
    both = handles(c[0])
    notes = F.when(has(4), strip(c[3])).otherwise(NO_NOTES)
    actual = clean_institution(c[2])
    kinds = {
        "confirmed": (
            has(5) & (both["primary"].isNotNull() | (F.size(both["alts"]) > 0)),
            [both["primary"], both["alts"], or_null(c[1]), clean_institution(c[2]), strip(c[3]), F.lit("manual_R07"), linked(c[4]), first_url(c[4]), F.lit(False), none],
        ),
        "unknown": (
            clean_handle(c[0]).isNotNull() & (clean_handle(c[0]) != ""),
            [clean_handle(c[0]), no_alts, or_null(c[1]), F.lit("Independent"), F.lit("Confirmed"), F.lit("manual_R07"), F.when(notes == "", EMPTY_NOTES).otherwise(notes), none, F.lit(False), none],
        ),
        "corrections": (
            has(3) & clean_handle(c[0]).isNotNull(),
            [clean_handle(c[0]), no_alts, none, F.when(actual == "", "Unknown").otherwise(actual), F.lit("Confirmed"), F.lit("manual_R07"), strip_markdown(F.coalesce(c[3], F.lit(""))), first_url(F.coalesce(c[3], F.lit(""))), F.lit(True), strip(strip_markdown(c[1]))],
        ),
        "header": (
            has(4),
            [clean_handle(c[1]), no_alts, or_null(c[0]), clean_institution(c[3]), F.lit("Confirmed"), F.lit("eip_header_email"), F.concat(F.lit("EIP header email: "), strip(c[2])), F.lit(header_url).cast("string"), F.lit(False), none],
        ),
    }
    names = [f.split()[0] for f in ENTRY.split(", ")]
    own = [n for n in names if n not in ("case", "section")]
    body = tables.filter(F.col("row") > 0)
    out = None
    for heading, (kind, case, section) in sections.items():
        keep, values = kinds[kind]
        rows = body.filter((F.col("heading") == heading) & keep).select(*[v.alias(n) for v, n in zip(values, own, strict=True)], F.lit(case).alias("case"), F.lit(section).alias("section"))
        out = rows if out is None else out.unionByName(rows)
    return out.select(names)


def wrapped(head: Column, label: Column, longest: int = 38, part: int = 32, reach: int = 12) -> Column:
    """head: label, in two lines if it is longer than longest: parted at its ampersands, or else at the space nearest to the label's middle."""
    base = F.concat(head, F.lit(": "), label)
    mid = F.floor(F.length(label) / 2).cast("int")
    steps = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(reach - 1)), lambda o: F.array(mid + o, mid - o)))
    at = F.get(F.filter(steps, lambda i: (i > 0) & (i < F.length(label)) & (F.substr(label, i + 1, F.lit(1)) == " ")), F.lit(0))
    halves = F.concat(head, F.lit(": "), F.substr(label, F.lit(1), at), F.lit("\n"), F.substr(label, at + 2))
    return F.when(F.length(base) <= longest, base).when(base.contains(" & "), F.replace(base, F.lit(" & "), F.lit(" &\n"))).when((F.length(label) > part) & at.isNotNull(), halves).otherwise(base)
