"""Queries on unions, joins, identity, merging and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.functions import predicates
from plenum.operators import identity
from plenum.plans.registry import EV, discourse, query
from plenum.storage import table


@query(
    """SELECT 'document' AS source, CAST(doc_id AS VARCHAR) AS record_id, length(text) AS n_chars FROM documents WHERE length(trim(text)) >= 20 AND source <> 'src0'
  UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), length(html) FROM pages WHERE length(trim(html)) >= 20
  UNION ALL SELECT 'turn', concat_ws('_', conv_id, turn), length(text) FROM conversations WHERE length(trim(text)) >= 20 AND role <> 'system'"""
)
def union_filter_tag(spark, sf_dir):
    """Records of three sources as one table with a tag; bots and short texts go."""
    d = table(spark, sf_dir, "documents").filter(~predicates.is_bot(F.col("source"), {"src0"}, ["[bot]", "-bot"])).select(F.lit("document").alias("source"), F.col("doc_id").cast("string").alias("record_id"), "text")
    p = table(spark, sf_dir, "pages").select(F.lit("page").alias("source"), F.col("page_id").cast("string").alias("record_id"), F.col("html").alias("text"))
    c = table(spark, sf_dir, "conversations").filter(~predicates.is_bot(F.col("role"), {"system"}, ["[bot]"])).select(F.lit("turn").alias("source"), F.concat_ws("_", "conv_id", "turn").alias("record_id"), "text")
    return d.unionByName(p).unionByName(c).filter(predicates.long_enough(F.col("text"), 20)).select("source", "record_id", F.length("text").cast("long").alias("n_chars"))


@query(
    """SELECT o_orderpriority, count(*) AS n, o_orderpriority IN ('1-URGENT', '2-HIGH') AS kept, CASE o_orderpriority WHEN '1-URGENT' THEN 'first' WHEN '2-HIGH' THEN 'second' END AS description FROM orders GROUP BY 1"""
)
def whitelist_split(spark, sf_dir):
    """Rows by key, kept if the white list has it, with its description."""
    allowed = spark.createDataFrame([("1-URGENT", "first"), ("2-HIGH", "second")], "o_orderpriority string, description string")
    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(allowed), "o_orderpriority", "left").select("o_orderpriority", "n", F.col("description").isNotNull().alias("kept"), "description")


@query(
    """SELECT c_custkey, s_suppkey, n_name, coalesce(s_name, c_name) AS canonical FROM customer JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN supplier ON lower(trim(replace(s_name, 'Supplier', 'Customer'))) = lower(trim(c_name)) AND length(trim(c_name)) > 3"""
)
def identity_resolve(spark, sf_dir):
    """Customers and suppliers of one name are one identity; the supplier's handle is preferred."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    same = identity.same_name(c, s.withColumn("as_customer", F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))), "c_name", "as_customer")
    al = same.select("c_name", "s_name", "s_suppkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = c.join(al, "c_name", "left").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.select("c_custkey", "s_suppkey", "n_name", F.coalesce("s_name", "c_name").alias("canonical"))


_ENTRIES = """e AS (SELECT lower(s_name) AS handle, n_name AS institution, 'manual_R07' AS source, CASE WHEN s_acctbal > 5000 THEN 'Confirmed' ELSE 'Probable' END AS confidence, s_suppkey AS pos FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT lower(replace(c_name, 'Customer', 'Supplier')), c_mktsegment, 'lm_inferred', 'LM_inferred', 1000000 + c_custkey FROM customer)"""
_RANKS = "CASE source WHEN 'manual_R07' THEN 6 ELSE 1 END DESC, CASE confidence WHEN 'Confirmed' THEN 4 WHEN 'Probable' THEN 2 ELSE 1 END DESC, pos"


@query(f"WITH {_ENTRIES}, r AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY {_RANKS}) AS i FROM e) SELECT handle, institution, source, confidence FROM r WHERE i = 1")
def priority_merge(spark, sf_dir):
    """The best-founded affiliation of each handle."""
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.col("s_name").alias("handle"), F.col("n_name").alias("institution"), F.lit("manual_R07").alias("source"), F.when(F.col("s_acctbal") > 5000, "Confirmed").otherwise("Probable").alias("confidence"), F.col("s_suppkey").alias("pos"))
    c = table(spark, sf_dir, "customer").select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("handle"), F.col("c_mktsegment").alias("institution"), F.lit("lm_inferred").alias("source"), F.lit("LM_inferred").alias("confidence"), (F.col("c_custkey") + 1000000).alias("pos"))
    return identity.best_entry(s.unionByName(c), "handle", "source", "confidence", "pos").select(F.col("_handle").alias("handle"), "institution", "source", "confidence")


@query("SELECT l_suppkey AS actor, count(DISTINCT l_returnflag) AS cases, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag = 'R') > 0")
def cross_overlap(spark, sf_dir):
    """Actors that are in both cases."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("actor")).agg(F.collect_set("l_returnflag").alias("c"), F.count("*").alias("n"))
    return t.filter(F.array_contains("c", "A") & F.array_contains("c", "R")).select("actor", F.size("c").cast("long").alias("cases"), "n")


@query(
    """SELECT count(DISTINCT o_custkey) AS authors, count(DISTINCT o_custkey) FILTER (c_mktsegment <> 'BUILDING') AS outside,
  round(CAST(count(DISTINCT o_custkey) FILTER (c_mktsegment <> 'BUILDING') AS DOUBLE) / count(DISTINCT o_custkey), 6) AS openness FROM orders JOIN customer ON c_custkey = o_custkey"""
)
def openness_index(spark, sf_dir):
    """Share of authors from outside the initiating organisation."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    n, out = F.countDistinct("o_custkey"), F.countDistinct(F.when(F.col("c_mktsegment") != "BUILDING", F.col("o_custkey")))
    return j.agg(n.alias("authors"), out.alias("outside"), F.round(out / n, 6).alias("openness"))


@query("WITH i AS (SELECT CAST(doc_id AS VARCHAR) AS id, source FROM documents) SELECT source, string_agg(id, ',' ORDER BY CAST(id AS BIGINT)) AS ids, count(*) AS n FROM i GROUP BY 1")
def numeric_id_join(spark, sf_dir):
    """Ids that come as text, in the order of their numbers, as one text for each source."""
    i = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "source")
    return i.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.expr("try_cast(id as bigint)"))), lambda x: x.cast("string")), ",").alias("ids"), F.count("*").alias("n"))


@query(
    """SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN concat_ws('_', d.source, d.doc_id) ELSE 'u' || d.doc_id END AS record_id, l.quality, CAST(CASE WHEN l.toxic = 1 THEN -1 WHEN l.quality = 1 THEN 1 ELSE 0 END AS DOUBLE) AS stance_val
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""
)
def joined_discourse(spark, sf_dir):
    """Coded rows met with records under a url, or under a composite key where they have none; the last of equal keys counts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("u"), F.col("doc_id"))).alias("url"))
    key = lambda: F.coalesce(predicates.truthy(F.col("url")), F.concat_ws("_", "source", "doc_id"))
    records = d.withColumn("record_id", key()).groupBy("record_id").agg(F.max_by("doc_id", "doc_id").alias("doc_id"))
    coded = table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("record_id", key()).select("record_id", "quality", "toxic")
    score = F.when(F.col("toxic") == 1, -1.0).when(F.col("quality") == 1, 1.0).otherwise(0.0)
    return coded.join(records, "record_id").select("doc_id", "record_id", "quality", score.alias("stance_val"))


@query(
    """SELECT source, round(avg(CAST(l.doc_id IS NOT NULL AS INTEGER)), 6) AS hit_rate, round(avg(CAST(n_chars >= 20 AS INTEGER)), 6) AS eligible_rate, count(*) FILTER (n_chars >= 20) AS eligible FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1"""
)
def hit_rates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left")
    return d.groupBy("source").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("hit_rate"), F.round(F.avg((F.col("n_chars") >= 20).cast("int")), 6).alias("eligible_rate"), F.count_if(F.expr("n_chars >= 20")).alias("eligible"))


@query(
    """SELECT role, source_a, n FROM (SELECT role, role IN ('system') OR role LIKE '%[bot]' OR role LIKE '%-bot' AS source_a, count(*) AS n FROM conversations GROUP BY 1, 2)
  UNION ALL SELECT source, lower(source) LIKE '%src1%', count(*) FROM documents WHERE length(trim(text)) >= 30 AND NOT (text LIKE '/%' AND length(text) < 20) GROUP BY 1, 2"""
)
def bot_filters(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("role", predicates.is_bot(F.col("role"), {"system"}, ["[bot]", "-bot"]).alias("source_a")).agg(F.count("*").alias("n"))
    d = table(spark, sf_dir, "documents").filter(predicates.vote_record(F.col("text")))
    return c.unionByName(d.groupBy(F.col("source").alias("role"), predicates.contains_name(F.col("source"), "src1").alias("source_a")).agg(F.count("*").alias("n")))


@query(
    """SELECT CASE WHEN p IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN p ELSE 'Off-topic' END AS category, count(*) AS n FROM (SELECT coalesce(nullif(CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END, ''), o_orderstatus) AS p FROM orders) GROUP BY 1"""
)
def field_fallback(spark, sf_dir):
    """A field of the annotation, else of the record; unknown values fold into one."""
    o = table(spark, sf_dir, "orders").withColumn("a", F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority")))
    return o.groupBy(predicates.fold(predicates.first_of(F.col("a"), F.col("o_orderstatus")), ["1-URGENT", "2-HIGH", "3-MEDIUM"]).alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {EV}, t AS (SELECT actor, category, count(*) AS n FROM ev GROUP BY ALL) SELECT actor, string_agg(category || ':' || n, '; ' ORDER BY category) AS summary, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1")
def map_summary(spark, sf_dir):
    e = discourse(spark, sf_dir)
    m = identity.count_map(e, ["actor"], "category", "m")
    return m.select("actor", identity.map_text(F.col("m")).alias("summary"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
