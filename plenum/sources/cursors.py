"""A streaming source of interfaces that are read by cursor, whose offset is the cursor.

A client is named as module:function (see paged); it takes (endpoint, cursor or None) and returns {"nodes": [...], "pageInfo": {"hasNextPage", "endCursor"}}, or None
where there is nothing. A batch follows PAGES cursors. On the last page the offset also counts the items that were taken, so that a later
batch takes what has been added to it. A stream goes on from its checkpoint at the cursor where it stopped, and a batch that is run again asks
for the same pages.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from plenum.sources.paged import client

#: Pages of a batch.
PAGES = 50


def landed_answer(endpoint: str, cursor: str | None) -> dict | None:
    """A client of pages that lie in a folder of any file system that Arrow knows: the first file of the folder cursor=<cursor>, or of cursor=0."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(endpoint)
    files = [f.path for f in system.get_file_info(fs.FileSelector(f"{path}/cursor={cursor or 0}", allow_not_found=True)) if f.size and "/part-" in f.path]
    if not files:
        return None
    with system.open_input_stream(sorted(files)[0]) as f:
        return json.loads(f.read())


class CursorReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict, fields: list[str]):
        self.client, self.endpoint, self.fields = options["client"], options.get("endpoint", ""), fields
        self.pages = int(options.get("pages_per_batch", PAGES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": None, "taken": 0}

    def _page(self, at: dict) -> tuple[list[dict], dict]:
        """The items of a page that were not taken yet, and the offset behind them."""
        answer = client(self.client)(self.endpoint, at["after"]) or {}
        nodes, info = answer.get("nodes") or [], answer.get("pageInfo") or {}
        more = info.get("hasNextPage") and info.get("endCursor") not in (None, at["after"])
        return nodes[at["taken"] :], {"after": info["endCursor"], "taken": 0} if more else {"after": at["after"], "taken": max(at["taken"], len(nodes))}

    def _row(self, item: dict) -> tuple:
        return tuple(None if (x := item.get(f)) is None else x if isinstance(x, str) else json.dumps(x) for f in self.fields)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, at = [], start
        for _ in range(self.pages):
            found, then = self._page(at)
            rows += found
            if then == at:
                break
            at = then
        return iter([self._row(x) for x in rows]), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        at = start
        while at != end:
            found, then = self._page(at)
            last = at["after"] == end["after"]  # a page that has grown since gives what it gave then
            yield from map(self._row, found[: end["taken"] - at["taken"]] if last else found)
            at = end if last else then
            if not last and then["taken"]:
                return


class CursorSource(DataSource):
    """spark.readStream.format("cursor").schema("id string, ...").option("client", "package.module:function").option("endpoint", url).load(); all columns are text."""

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> str:
        return "id string, author string, date string, raw_text string, url string"

    def simpleStreamReader(self, schema) -> CursorReader:  # noqa: N802
        return CursorReader(self.options, [f.name for f in schema.fields])
