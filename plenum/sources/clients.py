"""Clients' loops over cursors, topics and retries, with the request itself as an argument.

A request is a function that returns parsed JSON. What the loops yield is landed as JSON lines and read with
Spark; a loop follows a cursor that only the page before it knows, so it runs in one place.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

#: Posts of a topic that one request asks for.
BATCH = 20


def with_status(output: str) -> tuple[str, int]:
    """Body and status of a response whose last line is the status; 0 where that is no number."""
    body, _, status = output.rpartition("\n")
    return (body, int(status)) if status.strip().isdigit() else (output, 0)


def parsed(output: str) -> object | None:
    """The JSON of a response with status 200; None for others, and for what is no JSON."""
    body, status = with_status(output)
    if status != 200:
        return None
    try:
        return json.loads(body)
    except json.JSONDecodeError:
        return None


def pages(fetch: Callable[[int], list[dict] | None], size: int = 100, start_page: int = 1, max_pages: int | None = None) -> Iterator[dict]:
    """Rows of numbered pages up to the first missing, empty or short one."""
    page = start_page
    while max_pages is None or page < start_page + max_pages:
        rows = fetch(page) or []
        yield from rows
        if len(rows) < size:
            return
        page += 1


def cursor(fetch: Callable[[str | None], dict | None]) -> Iterator[dict]:
    """Nodes of connections ({nodes, pageInfo: {hasNextPage, endCursor}}), from one cursor to the next; a failed request ends them."""
    after = None
    while True:
        answer = fetch(after)
        if not answer:
            return
        yield from answer.get("nodes") or []
        info = answer.get("pageInfo") or {}
        if not info.get("hasNextPage") or info.get("endCursor") in (None, after):
            return
        after = info["endCursor"]


def discussions(fetch: Callable[[str | None], dict | None], fetch_comments: Callable[[int, str | None], dict | None]) -> Iterator[dict]:
    """Discussions with all their comments, of which the first request brings only a page."""
    for d in cursor(fetch):
        first = d.get("comments") or {}
        nodes, info = list(first.get("nodes") or []), first.get("pageInfo") or {}
        if info.get("hasNextPage"):
            start = info.get("endCursor")
            nodes += cursor(lambda after, d=d, start=start: fetch_comments(d["number"], after or start))
        yield d | {"comments": [c | {"replies": list(((c.get("replies") or {}).get("nodes")) or [])} for c in nodes]}


def topic_posts(fetch_topic: Callable[[], dict | None], fetch_posts: Callable[[list[int]], list[dict] | None], batch: int = BATCH) -> Iterator[dict]:
    """Posts of a topic: those that come with it, then the rest of its stream of ids in batches; a batch that fails is tried once more."""
    topic = fetch_topic() or {}
    stream = topic.get("post_stream") or {}
    posts = stream.get("posts") or []
    yield from posts
    have = {p["id"] for p in posts}
    left = [k for k in stream.get("stream") or [] if k not in have]
    for at in range(0, len(left), batch):
        ids = left[at : at + batch]
        yield from fetch_posts(ids) or fetch_posts(ids) or []


def settings(lines: Iterator[str], names: dict[str, str | None], environment: dict[str, str] | None = None) -> dict[str, str | None]:
    """Values by name from the environment, else from NAME=value lines (comments and quotes left out), else the defaults given."""
    own: dict[str, str] = {}
    for line in lines:
        key, mark, value = line.strip().partition("=")
        if mark and not key.startswith("#"):
            own[key.strip().removeprefix("export ").strip()] = value.strip().strip("\"'")
    environment = dict(os.environ) if environment is None else environment
    return {k: environment.get(k) or own.get(k) or default for k, default in names.items()}
