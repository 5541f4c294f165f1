"""Record mappers, paged sources and streams."""

from __future__ import annotations

import json

from plenum.sources import clients, cursors, paged, records
from plenum.streaming import live


def host(endpoint: str, page: int, size: int) -> list[dict]:
    """A client that stands for an interface of 2 full pages and a short one."""
    n = {1: size, 2: size, 3: 7}.get(page, 0) if endpoint == "ok" else 0
    return [{"id": page * 1000 + k, "author": {"login": "a"}, "url": None} for k in range(n)]


def test_paged_source_stops_at_the_first_short_page(spark):
    spark.dataSource.register(paged.PagedSource)
    read = lambda end="ok", **o: spark.read.format("paged").schema("id string, author string, url string").options(client="tests.test_sources_and_streams:host", endpoint=end, **o).load()
    assert read().count() == read(pages_per_partition=1).count() == 2 * paged.SIZE + 7
    assert read(start_page=3).count() == 7 and read(max_pages=1).count() == paged.SIZE and read(start_page=9).count() == 0 and read("none").count() == 0
    assert read(start_page=3).first()["author"] == '{"login": "a"}'


def test_landed_pages(spark, tmp_path):
    for page, n in ((1, 5), (2, 5), (3, 2), (4, 5), (10, 5)):
        (tmp_path / f"page-{page}.json").write_text(json.dumps([{"id": page * 100 + k} for k in range(n)]))
    (tmp_path / "other.json").write_text("[]")
    read = lambda *o: [r["id"] for r in paged.landed_pages(spark, str(tmp_path), "id long", *o, size=5).orderBy("page", "_pos").collect()]
    assert len(read()) == 12 and read()[-1] == 301 and read(2) == [*range(200, 205), 300, 301] and len(read(1, 1)) == 5 and read(4) == [*range(400, 405)] and read(6) == []
    assert paged.landed_pages(spark, str(tmp_path / "none"), "id long").count() == 0


def test_clients_follow_pages_and_cursors():
    got = list(clients.pages(lambda page: [{"p": page}] * {1: 3, 2: 3, 3: 1}.get(page, 3), size=3))
    assert [g["p"] for g in got] == [1, 1, 1, 2, 2, 2, 3] and len(list(clients.pages(lambda page: [1] * 3, size=3, max_pages=2))) == 6
    answers = {None: {"nodes": [1, 2], "pageInfo": {"hasNextPage": True, "endCursor": "x"}}, "x": {"nodes": [3], "pageInfo": {"hasNextPage": False}}}
    assert list(clients.cursor(answers.get)) == [1, 2, 3] and list(clients.cursor(lambda c: None)) == []
    assert list(clients.cursor(lambda c: {"nodes": [1], "pageInfo": {"hasNextPage": True, "endCursor": "same"}})) == [1, 1]  # a cursor that stays ends it


def test_discussions_have_all_comments():
    d = {"number": 7, "comments": {"nodes": [{"id": "a", "replies": {"nodes": [{"id": "r"}]}}], "pageInfo": {"hasNextPage": True, "endCursor": "k"}}}
    more = {"k": {"nodes": [{"id": "b"}], "pageInfo": {"hasNextPage": True, "endCursor": "l"}}, "l": {"nodes": [{"id": "c"}], "pageInfo": {"hasNextPage": False}}}
    got = list(clients.discussions(lambda after: {"nodes": [d], "pageInfo": {"hasNextPage": False}}, lambda number, after: more[after] if number == 7 else None))
    assert [c["id"] for c in got[0]["comments"]] == ["a", "b", "c"] and got[0]["comments"][0]["replies"] == [{"id": "r"}] and got[0]["comments"][1]["replies"] == []


def test_topics_come_in_batches_with_one_retry():
    asked = []

    def posts(ids):
        asked.append(ids)
        return None if len(asked) == 1 else [{"id": k} for k in ids]

    topic = {"post_stream": {"posts": [{"id": 1}, {"id": 2}], "stream": list(range(1, 26))}}
    assert [p["id"] for p in clients.topic_posts(lambda: topic, posts, batch=20)] == list(range(1, 26))
    assert [len(a) for a in asked] == [20, 20, 3]
    assert list(clients.topic_posts(lambda: None, posts)) == []
    assert [p["id"] for p in clients.topic_posts(lambda: topic, lambda ids: None)] == [1, 2]


def test_responses_and_settings():
    assert clients.with_status('{"a": 1}\n200') == ('{"a": 1}', 200) and clients.with_status("no status") == ("no status", 0)
    assert clients.parsed('{"a": 1}\n200') == {"a": 1} and clients.parsed("{}\n404") is None and clients.parsed("x\n200") is None
    lines = ["# A=no", "A = 'one'", 'export B="two"', "bad line", "C="]
    assert clients.settings(iter(lines), {"A": None, "B": None, "C": "c", "D": None}, {"B": "own"}) == {"A": "one", "B": "own", "C": "c", "D": None}


def test_corpus(spark):
    rows = [("1", "x", "ann", "d", "a text of twenty letters"), ("2", "x", "ci[bot]", "d", "a text of twenty letters"), ("3", "y", "ann", "d", "a text of twenty letters"), ("4", "x", None, "d", "short"), ("5", "x", "robo", "d", "a text of twenty letters"), ("6", "x", None, "d", None)]
    df = spark.createDataFrame(rows, "record_id string, _case string, author string, date string, raw_text string")
    assert [r["record_id"] for r in records.load_corpus(df, ["x"], ["robo"]).collect()] == ["1"]


def test_discussions_become_flat(spark, tmp_path):
    d = {"number": 4, "title": "T", "body": None, "createdAt": "2024-01-01", "author": {"login": "ann"}, "category": {"name": "Ideas"},
         "comments": [{"id": "c1", "body": "x", "author": None, "replies": [{"id": "r1", "body": "y", "author": {"login": "bob"}}]}, {"id": "c2", "body": "z", "replies": []}]}
    (tmp_path / "d.json").write_text(json.dumps(d))
    out = records.flatten_discussions(spark.read.schema(records.DISCUSSION).json(str(tmp_path / "d.json"))).collect()
    assert {(r["source"], r["comment_id"], r["parent_comment_id"], r["author"], r["raw_text"]) for r in out} == {("discussion", None, None, "ann", ""), ("discussion_comment", "c1", None, None, "x"), ("discussion_comment", "c2", None, None, "z"), ("discussion_reply", "r1", "c1", "bob", "y")}


def test_api_items(spark, tmp_path):
    items = [{"id": 9, "number": 3, "sha": "0123456789abcdef", "html_url": "u", "title": "t", "body": None, "state": "closed", "created_at": "2024-01-01T00:00:00Z", "merged_at": "2024-02-01T00:00:00Z", "user": {"login": "ann"}, "labels": [{"name": "x"}], "commit": {"message": "m", "author": {"name": "Ann", "date": "2024-01-01"}}}]
    (tmp_path / "i.json").write_text(json.dumps(items))
    df = spark.read.schema(records.API_ITEM).json(str(tmp_path / "i.json"), multiLine=True)
    assert records.pulls(df, "p").first()["merged"] is True and records.issues(df, "p").first()["labels"] == ["x"]
    assert records.commits(df, "p").first()["sha"] == "0123456789" and records.comments(df, "p").first()["comment_id"] == "9"
    (tmp_path / "repo.json").write_text(json.dumps({"full_name": "o/r", "stargazers_count": 5, "license": {"spdx_id": "MIT"}, "html_url": "u"}))
    r = records.repository(spark.read.schema(records.REPOSITORY).json(str(tmp_path / "repo.json"))).first()
    assert (r["full_name"], r["stars"], r["license"], r["forks"]) == ("o/r", 5, "MIT", None)
    h = spark.createDataFrame([("ann",), ("zed",), ("ann",)], "a string")
    p = spark.createDataFrame([("ann", True, "Ann")], "handle string, found boolean, name string")
    assert {(r["handle"], r["found"]) for r in records.lookup_profiles(h, "a", p).collect()} == {("ann", True), ("zed", False)}


def test_streams(spark, tmp_path):
    land = tmp_path / "in"
    land.mkdir()
    rows = [{"id": str(k % 4), "ts": f"2024-01-{1 + k:02d}T00:00:00Z", "t": "good text", "c": "x"} for k in range(8)]
    (land / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = live.landed(spark, str(land), "id string, ts timestamp, t string, c string")
    q = live.annotate_stream(live.once(stream, "id", "ts", "30 days"), "id", "t", str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("record_id").distinct().count() == 4
    batch = spark.read.schema("id string, ts timestamp, t string, c string").json(str(land))
    assert live.live_counts(batch, "ts", "c").agg({"n": "sum"}).first()[0] == 8


def test_pulls_keep_items_without_and_with_one_url(spark):
    items = spark.createDataFrame([(1, None, None), (2, "u", "2024-01-02"), (3, "u", None)], "number int, html_url string, merged_at string")
    for name, kind in (("id", "string"), ("created_at", "string"), ("closed_at", "string"), ("title", "string"), ("body", "string"), ("state", "string"), ("user", "struct<login:string>"), ("labels", "array<struct<name:string>>")):
        items = items.selectExpr("*", f"CAST(NULL AS {kind}) AS {name}")
    assert sorted((r["pr_number"], r["url"], r["merged"]) for r in records.pulls(items, "host").collect()) == [(1, None, False), (2, "u", True), (3, "u", False)]


def test_cursor_reader(monkeypatch):
    """Offsets are cursors; a batch asked for again gives what it gave, also when the last page has grown; a stream goes on where it stopped."""
    pages = {None: (["a", "b"], "x"), "x": (["c"], "y"), "y": (["d"], None)}

    def fetch(endpoint, after):
        nodes, to = pages[after]
        return {"nodes": [{"id": n, "tags": [n]} for n in nodes], "pageInfo": {"hasNextPage": to is not None, "endCursor": to}}

    monkeypatch.setattr(cursors, "client", lambda name: fetch if name == "m:f" else lambda e, c: None)
    r = cursors.CursorReader({"client": "m:f", "pages_per_batch": "2"}, ["id", "tags"])
    rows, one = r.read(r.initialOffset())
    assert [x[0] for x in rows] == ["a", "b", "c"] and one == {"after": "y", "taken": 0}
    rows, two = r.read(one)
    assert list(rows) == [("d", '["d"]')] and two == {"after": "y", "taken": 1}
    assert list(r.read(two)[0]) == [] and r.read(two)[1] == two
    pages["y"] = (["d", "e"], "z")
    pages["z"] = (["f"], None)
    assert [x[0] for x in r.readBetweenOffsets(one, two)] == ["d"]
    assert [x[0] for x in r.readBetweenOffsets(r.initialOffset(), one)] == ["a", "b", "c"]
    rows, three = r.read(two)
    assert [x[0] for x in rows] == ["e", "f"] and three == {"after": "z", "taken": 1}
    assert [x[0] for x in r.readBetweenOffsets(two, three)] == ["e", "f"]
    assert [x[0] for x in r.readBetweenOffsets(r.initialOffset(), three)] == ["a", "b", "c", "d", "e", "f"]
    none = cursors.CursorReader({"client": "other"}, ["id"])
    assert none.read(none.initialOffset())[1] == none.initialOffset()
