"""Queries that write and read back records, and map what interfaces return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.plans.records import REC, records
from plenum.plans.registry import query
from plenum.sources import files, paged
from plenum.sources import records as mappers
from plenum.storage import scratch, table


@query("SELECT n_nationkey, n_name, n_regionkey, 'first' AS _case, n_nationkey AS _pos FROM nation UNION ALL SELECT r_regionkey, r_name, NULL, 'second', r_regionkey FROM region")
def json_round_trip(spark, sf_dir):
    """Two JSON arrays written, read under one schema with the place of each object, tagged, and united; a file that is missing adds nothing."""
    nation, region = scratch(spark, "nation"), scratch(spark, "region")
    files.write_json_array(table(spark, sf_dir, "nation").orderBy("n_nationkey"), nation)
    files.write_json_array(table(spark, sf_dir, "region").orderBy("r_regionkey"), region)
    a = files.read_json_array(spark, f"{nation}/part-*", "n_nationkey int, n_name string, n_regionkey int")
    b = files.read_json_array(spark, f"{region}/part-*", "r_regionkey int, r_name string").withColumnsRenamed({"r_regionkey": "n_nationkey", "r_name": "n_name"})
    c = files.read_json_array(spark, f"{region}-none/part-*", "n_nationkey int, n_name string, n_regionkey int")
    return files.union(files.tag(a, "first"), files.tag(b, "second"), files.tag(c, "third"))


@query("SELECT s_name AS handle, s_suppkey % 5 > 0 AS found, CASE WHEN s_suppkey % 3 > 0 THEN 'Supplier ' || s_suppkey END AS name, s_acctbal AS balance FROM supplier")
def json_map_round_trip(spark, sf_dir):
    """An object of objects, each under its handle."""
    path = scratch(spark, "profiles")
    value = F.struct(F.expr("s_suppkey % 5 > 0").alias("found"), F.expr("CASE WHEN s_suppkey % 3 > 0 THEN 'Supplier ' || s_suppkey END").alias("name"), F.col("s_acctbal").alias("balance"))
    m = table(spark, sf_dir, "supplier").agg(F.map_from_entries(F.collect_list(F.struct("s_name", value))).alias("m"))  # one file, as the tools that write it make it
    m.select(F.to_json(F.struct(F.col("m").alias("profiles"))).alias("value")).coalesce(1).write.text(path)
    return files.read_json_map(spark, f"{path}/part-*", "found boolean, name string, balance double", "profiles")


@query("""SELECT s_suppkey, 'say "' || s_name || '",' || chr(10) || 'x' AS name, s_acctbal, CAST(s_suppkey AS VARCHAR) AS as_text FROM supplier""")
def csv_round_trip(spark, sf_dir):
    """Rows with quotes, commas and line ends in CSV, read typed and as text."""
    path = scratch(spark, "csv")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit('say "'), "s_name", F.lit('",\nx')).alias("name"), "s_acctbal")
    files.write_csv(s, path)
    typed = files.read_csv(spark, path, "s_suppkey long, name string, s_acctbal double")
    return typed.join(files.read_csv(spark, path).select(F.col("s_suppkey").alias("as_text")), F.col("as_text") == F.col("s_suppkey").cast("string"))


@query(f"WITH {REC} SELECT _case, source, count(*) AS n FROM rec WHERE annotation_error IS NULL GROUP BY 1, 2")
def valid_records(spark, sf_dir):
    """Records with an annotation and no error."""
    return files.valid_annotations(records(spark, sf_dir)).groupBy("_case", "source").agg(F.count("*").alias("n"))


@query(f"WITH {REC} SELECT _pos, _case, author, date, trim(text) AS text FROM rec WHERE _case = 'second' AND length(trim(coalesce(text, ''))) >= 20 AND author <> 'git-vote[bot]' AND author <> 'eip-review-bot'")
def corpus_loader(spark, sf_dir):
    """What a topic model reads: texts of one case, by people, and long enough."""
    r = records(spark, sf_dir).withColumnRenamed("text", "raw_text")
    return mappers.load_corpus(r, ["second"], ["eip-review-bot"], id_col="_pos")


@query("WITH p AS (SELECT *, (c_custkey - 1) // 100 + 1 AS page FROM customer WHERE c_custkey <= 1000) SELECT c_custkey, c_name, CAST(page AS INTEGER) AS page FROM p WHERE (page < 3 OR page = 3 AND c_custkey <= 237) UNION ALL SELECT c_custkey, c_name, CAST(page AS INTEGER) FROM p WHERE page = 4 AND false")
def paged_records(spark, sf_dir):
    """Pages that were landed: reading stops at the first short one, and may begin at a later one."""
    path = scratch(spark, "pages")
    c = table(spark, sf_dir, "customer").filter("c_custkey <= 237 or c_custkey between 301 and 400").select("c_custkey", "c_name", F.expr("CAST((c_custkey - 1) DIV 100 + 1 AS INT)").alias("page"))
    c.groupBy("page").agg(F.to_json(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name")))).alias("value")).write.partitionBy("page").text(path)  # a hundred rows a page
    read = lambda start, most: paged.landed_pages(spark, path, "c_custkey long, c_name string", start, most).drop("_pos")
    return read(1, 1).unionByName(read(2, 20))


@query("SELECT s_name AS handle, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END AS balance, s_suppkey % 2 = 0 AS found FROM supplier")
def profile_lookup(spark, sf_dir):
    """A row for each handle that is asked for; found is false where there is no profile."""
    s = table(spark, sf_dir, "supplier")
    asked = s.select(F.col("s_name").alias("author")).unionByName(s.select(F.col("s_name").alias("author")))
    known = s.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("handle"), F.lit(True).alias("found"), F.col("s_acctbal").alias("balance"))
    return mappers.lookup_profiles(asked, "author", known).select("handle", "balance", "found")


@query(f"WITH {REC}, a AS (SELECT source, count(*) AS n FROM rec WHERE _pos % 2 = 0 GROUP BY 1), b AS (SELECT source, count(*) AS n FROM rec WHERE source IN ('forum', 'commit') GROUP BY 1) SELECT * FROM b UNION ALL SELECT * FROM a WHERE source NOT IN (SELECT source FROM b)")
def manifest_update(spark, sf_dir):
    """Counts by source, brought up to date for the sources that were read again."""
    r = records(spark, sf_dir)
    return files.merge_manifest(files.manifest(r.filter("_pos % 2 = 0")), files.manifest(r.filter("source in ('forum', 'commit')")))


@query(f"WITH {REC} SELECT _pos, author FROM rec WHERE _pos % 3 = 0 UNION ALL SELECT _pos, author FROM rec WHERE _pos % 2 = 0 AND _pos % 3 > 0")
def merge_new_rows(spark, sf_dir):
    """Rows that a table lacks, each once, though the new ones come twice."""
    r = records(spark, sf_dir).select("_pos", "author")
    new = r.filter("_pos % 2 = 0")
    return files.merge_new(r.filter("_pos % 3 = 0"), new.unionByName(new), "_pos")


def items(spark, sf_dir) -> DataFrame:
    """Orders as a code host's interface returns them."""
    o = table(spark, sf_dir, "orders")
    date = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.select(
        F.expr("'c' || o_orderkey").alias("id"), F.col("o_custkey").cast("int").alias("number"), F.sha1(F.col("o_orderkey").cast("string")).alias("sha"), F.expr("'https://h/' || o_orderkey").alias("html_url"), F.expr("'https://h/issues/' || o_custkey").alias("issue_url"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'https://h/pulls/' || o_custkey END").alias("pull_request_url"), F.expr("'order ' || o_orderkey").alias("title"), F.expr("CASE WHEN o_orderkey % 3 > 0 THEN 'body ' || o_orderpriority END").alias("body"), F.lower("o_orderstatus").alias("state"),
        date.alias("created_at"), F.expr("CASE WHEN o_orderstatus = 'F' THEN '2000-01-01' END").alias("closed_at"), F.expr("CASE WHEN o_orderkey % 4 = 0 THEN '1999-01-01' END").alias("merged_at"), F.expr("CASE WHEN o_orderkey % 5 = 0 THEN '1998-01-01' END").alias("submitted_at"),
        F.expr("CASE WHEN o_custkey % 9 > 0 THEN struct('u' || o_custkey AS login) END").alias("user"), F.expr("array(struct(o_orderpriority AS name), struct('x' AS name))").alias("labels"),
        F.struct(F.expr("'message ' || o_orderkey").alias("message"), F.struct(F.expr("'Name ' || o_custkey").alias("name"), date.alias("date")).alias("author")).alias("commit"), F.expr("CASE WHEN o_orderkey % 2 = 0 THEN struct('u' || o_custkey AS login) END").alias("author"),
    )


_DATE = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"
_USER = "CASE WHEN o_custkey % 9 > 0 THEN 'u' || o_custkey END"


@query(
    f"""SELECT 'commit' AS source, substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 10) AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'u' || o_custkey ELSE 'Name ' || o_custkey END AS author, {_DATE} AS date, 'message ' || o_orderkey AS raw_text, NULL AS extra FROM orders
  UNION ALL SELECT 'issue', CAST(o_custkey AS VARCHAR), {_USER}, {_DATE}, CASE WHEN o_orderkey % 3 > 0 THEN 'body ' || o_orderpriority ELSE '' END, lower(o_orderstatus) || '|' || o_orderpriority || ',x' FROM orders
  UNION ALL SELECT 'pr', CAST(o_custkey AS VARCHAR), {_USER}, {_DATE}, CASE WHEN o_orderkey % 3 > 0 THEN 'body ' || o_orderpriority ELSE '' END, CASE WHEN o_orderkey % 4 = 0 THEN 'true' ELSE 'false' END FROM orders
  UNION ALL SELECT 'issue_comment', 'c' || o_orderkey, {_USER}, CASE WHEN o_orderkey % 5 = 0 THEN '1998-01-01' ELSE {_DATE} END, CASE WHEN o_orderkey % 3 > 0 THEN 'body ' || o_orderpriority ELSE '' END, 'https://h/issues/' || o_custkey FROM orders"""
)
def api_mappers(spark, sf_dir):
    """Commits, issues, pull requests and comments as flat records."""
    i = items(spark, sf_dir)
    pick = lambda df, key, extra: df.select("source", F.col(key).cast("string").alias("key"), "author", "date", "raw_text", extra.alias("extra"))
    return (
        pick(mappers.commits(i, "host"), "sha", F.lit(None).cast("string"))
        .unionByName(pick(mappers.issues(i, "host"), "issue_number", F.concat_ws("|", "state", F.array_join("labels", ","))))
        .unionByName(pick(mappers.pulls(i, "host"), "pr_number", F.col("merged").cast("string")))
        .unionByName(pick(mappers.comments(i, "host"), "comment_id", F.col("issue_url")))
    )


@query(
    """WITH d AS (SELECT conv_id, max(role) FILTER (turn = 0) AS author, count(*) AS n FROM conversations GROUP BY 1)
  SELECT 'discussion' AS source, conv_id AS discussion_number, CAST(NULL AS VARCHAR) AS comment_id, CAST(NULL AS VARCHAR) AS parent_comment_id, author, 'talk ' || conv_id AS raw_text FROM d
  UNION ALL SELECT 'discussion_comment', conv_id, 'c' || conv_id || '_' || turn, NULL, CASE WHEN turn % 4 > 0 THEN role END, coalesce(text, '') FROM conversations WHERE turn % 2 = 1
  UNION ALL SELECT 'discussion_reply', a.conv_id, 'r' || a.conv_id || '_' || a.turn, 'c' || b.conv_id || '_' || b.turn, a.role, coalesce(a.text, '') FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.turn % 2 = 0 AND a.turn > 0"""
)
def nested_flatten(spark, sf_dir):
    """Discussions with comments and their replies, nested as an interface returns them, as flat records."""
    c = table(spark, sf_dir, "conversations")
    one = lambda p: F.struct(F.concat(F.lit(p), "conv_id", F.lit("_"), "turn").alias("id"), F.col("text").alias("body"), F.lit("2024-01-01").alias("createdAt"), F.lit("u").alias("url"), F.lit(1).alias("upvoteCount"))
    replies = c.filter("turn % 2 = 0 and turn > 0").select("conv_id", (F.col("turn") - 1).alias("turn"), one("r").withField("author", F.struct(F.col("role").alias("login"))).alias("reply"))
    author = F.when(F.col("turn") % 4 > 0, F.struct(F.col("role").alias("login")))
    comments = c.filter("turn % 2 = 1").select("conv_id", "turn", one("c").withField("author", author).alias("comment")).join(replies, ["conv_id", "turn"], "left")
    nested = comments.select("conv_id", F.col("comment").withField("replies", F.when(F.col("reply").isNotNull(), F.array("reply")).otherwise(F.array().cast("array<struct<id:string,body:string,createdAt:string,url:string,upvoteCount:int,author:struct<login:string>>>"))).alias("comment"))
    nested = nested.groupBy("conv_id").agg(F.collect_list("comment").alias("comments"))  # the comments of one discussion
    heads = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("role"))).alias("role"))
    d = heads.join(nested, "conv_id", "left").select(
        F.col("conv_id").cast("int").alias("number"), F.lit("t").alias("title"), F.expr("'talk ' || conv_id").alias("body"), F.lit("2024-01-01").alias("createdAt"), F.lit("u").alias("url"), F.lit(1).alias("upvoteCount"), F.struct(F.col("role").alias("login")).alias("author"), F.struct(F.lit("Ideas").alias("name")).alias("category"), "comments",
    )
    flat = mappers.flatten_discussions(d)
    return flat.select("source", F.col("discussion_number").cast("long").alias("discussion_number"), "comment_id", "parent_comment_id", "author", "raw_text")


@query("SELECT 'o/' || r_name AS full_name, r_regionkey AS stars, 'MIT' AS license, 'main' AS default_branch, 'https://h/' || r_name AS url FROM region")
def repository_row(spark, sf_dir):
    """Metadata of repositories."""
    r = table(spark, sf_dir, "region").select(
        F.expr("'o/' || r_name").alias("full_name"), F.lit("d").alias("description"), F.lit("2024").alias("created_at"), F.lit("2025").alias("updated_at"), F.col("r_regionkey").alias("stargazers_count"), F.lit(1).alias("forks_count"), F.lit(2).alias("open_issues_count"),
        F.lit("main").alias("default_branch"), F.struct(F.lit("MIT").alias("spdx_id")).alias("license"), F.expr("'https://h/' || r_name").alias("html_url"),
    )
    return mappers.repository(r).select("full_name", "stars", "license", "default_branch", "url")


@query("SELECT 'node' AS kind, CAST(s_suppkey AS VARCHAR) AS a, s_name AS b, NULL AS weight FROM supplier WHERE s_suppkey % 7 > 0 UNION ALL SELECT 'edge', CAST(s_suppkey AS VARCHAR), 'pr_' || s_nationkey, CAST(1.5 AS DOUBLE) FROM supplier")
def exported_edges(spark, sf_dir):
    """Nodes without those of threads, and edges, as CSV files read back."""
    path = scratch(spark, "export")
    s = table(spark, sf_dir, "supplier")
    nodes = s.select(F.expr("CASE WHEN s_suppkey % 7 = 0 THEN 'pr_' || s_suppkey ELSE CAST(s_suppkey AS STRING) END").alias("id"), F.col("s_name").alias("label"))
    edges = s.select(F.col("s_suppkey").cast("string").alias("source"), F.expr("'pr_' || s_nationkey").alias("target"), F.lit("pr_edge").alias("type"), F.lit(1.5).alias("weight"))
    files.edge_export(nodes, edges, path)
    n = files.read_csv(spark, f"{path}/nodes.csv").select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("label").alias("b"), F.lit(None).cast("double").alias("weight"))
    return n.unionByName(files.read_csv(spark, f"{path}/edges.csv").select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.col("weight").cast("double").alias("weight")))


@query("SELECT 'first' AS name, 3 AS posts, CAST(NULL AS BIGINT) AS commits UNION ALL SELECT 'second', NULL, (SELECT count(*) FROM orders)")
def united_metrics(spark, sf_dir):
    """Metrics of cases that have not the same ones, as one CSV under all their names."""
    path = scratch(spark, "metrics")
    a = spark.range(1).select(F.lit("first").alias("name"), F.lit(3).alias("posts"))
    b = table(spark, sf_dir, "orders").agg(F.lit("second").alias("name"), F.count("*").alias("commits"))
    files.write_csv(files.union(a, b), path)
    return files.read_csv(spark, path, "name string, posts int, commits long")


@query("SELECT 'node' AS kind, 'n' || n_nationkey AS a, n_name || ' </script> & co' AS b FROM nation UNION ALL SELECT 'edge', 'n' || n_nationkey, 'r' || n_regionkey FROM nation")
def graph_page(spark, sf_dir):
    """A graph as a page, and what the page holds."""
    from plenum.sources.drawings import graph_page as page

    path = scratch(spark, "page") + "/graph.html"
    n = table(spark, sf_dir, "nation")
    nodes = n.select(F.expr("'n' || n_nationkey").alias("id"), F.expr("n_name || ' </script> & co'").alias("label"), F.lit("#46a").alias("color"))
    edges = n.select(F.expr("'n' || n_nationkey").alias("src"), F.expr("'r' || n_regionkey").alias("dst"))
    page(spark, path, "Nations <all>", {"nations": (nodes, edges)}, {"nation": "#46a"})
    held = F.regexp_extract("value", r'(?s)<script type="application/json" id="graphs">(.*?)</script>', 1)
    g = spark.read.text(path, wholetext=True).select(F.from_json(held, "array<struct<nodes:array<struct<id:string,label:string>>,edges:array<struct<src:string,dst:string>>>>").alias("g")).select(F.explode("g").alias("g"))
    return g.select(F.explode("g.nodes").alias("x")).select(F.lit("node").alias("kind"), F.col("x.id").alias("a"), F.col("x.label").alias("b")).unionByName(g.select(F.explode("g.edges").alias("x")).select(F.lit("edge").alias("kind"), F.col("x.src").alias("a"), F.col("x.dst").alias("b")))


@query("WITH n AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1) SELECT label, n, round(400.0 * n / max(n) OVER (), 2) AS width FROM n")
def bar_figure(spark, sf_dir):
    """Bars as SVG, and their lengths read back."""
    from plenum.sources.drawings import bar_figure as figure

    path = scratch(spark, "figure") + "/bars.svg"
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    figure(spark, path, "Orders", n, "label", "n")
    svg = spark.read.text(path, wholetext=True)
    one = F.explode(F.arrays_zip(*[F.regexp_extract_all("value", F.lit(p), 1).alias(c) for c, p in (("label", r'text-anchor="end">([^<]*)<'), ("width", r'width="([0-9.]+)" height="16"'), ("n", r'"/><text [^>]*>([^<]*)<'))]))
    return svg.select(one.alias("x")).select("x.label", F.col("x.n").cast("long").alias("n"), F.col("x.width").cast("double").alias("width"))


@query("SELECT sha256(n_name || chr(10)) AS sha256, length(n_name) + 1 AS bytes, CAST(1 AS BIGINT) AS lines FROM nation")
def written_checksums(spark, sf_dir):
    """Digest, bytes and lines of files that were written, one for each nation."""
    path = scratch(spark, "files")
    table(spark, sf_dir, "nation").select(F.col("n_name").alias("value"), "n_nationkey").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    return files.checksums(spark, f"{path}/*/*.txt").select("sha256", "bytes", F.col("lines").cast("long").alias("lines"))
