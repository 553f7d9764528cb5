"""Text, JSON, hashes and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import names, periods
from tidewatch.operators import snapshots
from tidewatch.plans import query, table


@query("""
SELECT doc_id, CASE WHEN contains(text, 'neutral') THEN NULL WHEN contains(text, 'the') THEN 'ARTICLE' WHEN contains(text, 'an') THEN 'SYLLABLE' WHEN contains(text, '.') THEN 'STOP' END AS event_type,
       CASE WHEN contains(text, 'neutral') THEN NULL WHEN contains(text, 'the') THEN 'the' WHEN contains(text, 'an') THEN 'an' WHEN contains(text, '.') THEN '.' END AS keyword
FROM documents
""")
def keyword_classify(spark, sf_dir):
    """Documents by the first keyword of an ordered list that they contain."""
    found = names.first_keyword(F.col("text"), [("ARTICLE", "the"), ("SYLLABLE", "an"), ("STOP", ".")], ["neutral"])
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("f")).select("doc_id", "f.event_type", "f.keyword")


@query(r"SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host, nullif(regexp_extract(url, '([0-9]+)', 1), '') AS digits, regexp_matches(url, '[0-9]{3}') AS has_three FROM pages")
def regex_extract_period(spark, sf_dir):
    """Captures from a URL, null where there is none."""
    grab = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", grab(r"^https?://([^/]+)").alias("host"), grab(r"([0-9]+)").alias("digits"), F.col("url").rlike("[0-9]{3}").alias("has_three"))


@query("""
WITH t AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS token FROM part),
k AS (SELECT token, count(*) AS n, min(p_partkey) AS one FROM t GROUP BY 1)
SELECT token, n, CASE WHEN n = 1 THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n = 1 THEN one END AS part FROM k
""")
def consortium_split(spark, sf_dir):
    """Names split into members, each linked where only one part has it."""
    t = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("token"))
    k = t.groupBy("token").agg(F.count("*").alias("n"), F.min("p_partkey").alias("one"))
    return k.select("token", "n", F.when(F.col("n") == 1, "MATCHED").otherwise("AMBIGUOUS").alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("part"))


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) AS n FROM events GROUP BY 1")
def json_extract(spark, sf_dir):
    """Sums over a field of JSON text."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k_sum"), F.count("*").alias("n"))


@query("""
SELECT n_regionkey, '[' || string_agg('{"key":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS nations FROM nation GROUP BY 1
""")
def json_build(spark, sf_dir):
    """Ordered JSON arrays of objects."""
    row = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list(row)), {"ignoreNullFields": "false"}).alias("nations"))


@query("""
WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '=' || c_name WHEN 1 THEN '-' || c_name WHEN 2 THEN '@' || c_name ELSE c_name END AS raw FROM customer)
SELECT c_custkey, CASE WHEN raw[1] IN ('=', '+', '-', '@') THEN '''' || raw ELSE raw END AS safe FROM t
""")
def csv_sanitized(spark, sf_dir):
    """Text fields that no spreadsheet takes for formulas."""
    k = F.col("c_custkey") % 4
    raw = F.concat(F.when(k == 0, "=").when(k == 1, "-").when(k == 2, "@").otherwise(""), "c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", names.csv_safe(raw).alias("safe"))


@query("""
SELECT o_orderkey, sha256(o_orderstatus || '/' || o_orderpriority || CASE WHEN o_orderkey % 10 = 0 THEN '!' ELSE '' END) AS digest FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 = 0
""")
def sha_changed(spark, sf_dir):
    """Payloads whose digest differs from the stored one, or that are new (every 7th was not stored)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("p"))
    new = o.withColumn("p", F.concat("p", F.when(F.col("o_orderkey") % 10 == 0, "!").otherwise("")))
    return snapshots.changed_payload(o.where("o_orderkey % 7 != 0"), new, ["o_orderkey"], "p")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 7 = 0 THEN 'INSERTED' WHEN o_orderkey % 11 = 0 THEN 'ABSENT' WHEN o_orderkey % 5 = 0 THEN 'UPDATED' ELSE 'SAME' END AS change
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 AND o_orderkey % 5 = 0 THEN o_orderstatus ELSE o_orderstatus END AS o_orderstatus FROM orders)
WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey % 11 = 0) AND NOT (o_orderkey % 11 = 0 AND o_orderkey % 5 = 0)
UNION ALL
SELECT o_orderkey, o_orderstatus, 'ABSENT' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0
""")
def upsert_changed_only(spark, sf_dir):
    """Two snapshots of orders merged, with what happened to each."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = o.where("o_orderkey % 11 != 0").withColumn("o_orderstatus", F.expr("if(o_orderkey % 5 = 0, 'X', o_orderstatus)"))
    return snapshots.upsert(o.where("o_orderkey % 7 != 0"), new, ["o_orderkey"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(CASE WHEN o_orderkey % 6 = 0 THEN DATE '2020-01-01' END, DATE '2024-05-05') END AS removed_at FROM orders
""")
def soft_delete(spark, sf_dir):
    """Keys gone from the newer snapshot are marked (first mark kept), those back again unmarked."""
    import datetime

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 == 0, F.lit(datetime.date(2020, 1, 1))).when(F.col("o_orderkey") % 6 == 1, F.lit(datetime.date(2021, 1, 1))).alias("removed_at"))
    return snapshots.soft_delete(o, o.where("o_orderkey % 3 != 0"), ["o_orderkey"], datetime.date(2024, 5, 5))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'MANUAL' ELSE 'NAME' END AS method, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 1 END AS target FROM orders
""")
def manual_override(spark, sf_dir):
    """New mappings put over old ones except where someone chose by hand."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "MANUAL").otherwise("NAME").alias("method"), F.col("o_custkey").alias("target"))
    new = o.where("o_orderkey % 3 != 0").select("o_orderkey", F.lit("NAME").alias("method"), (F.col("target") + 1).alias("target"))
    return snapshots.keep_manual(o, new, ["o_orderkey"])


@query("""
SELECT o_orderkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS ordinal,
       year(o_orderdate - INTERVAL 12 month) || 'Q' || quarter(o_orderdate - INTERVAL 12 month) AS year_ago,
       strftime(o_orderdate - INTERVAL 3 month, '%Y%m') AS month_back,
       CAST(CASE quarter(o_orderdate) WHEN 1 THEN make_date(year(o_orderdate), 5, 18) WHEN 2 THEN make_date(year(o_orderdate), 8, 17) WHEN 3 THEN make_date(year(o_orderdate), 11, 17) ELSE make_date(year(o_orderdate) + 1, 4, 3) END AS DATE) AS available
FROM orders
""")
def period_keys(spark, sf_dir):
    """Quarter and month keys, their arithmetic, and when a quarter's report is public."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("period"), F.date_format("o_orderdate", "yyyyMM").alias("m"))
    return o.select("o_orderkey", "period", periods.quarter_ordinal(F.col("period")).alias("ordinal"), periods.shift_quarter(F.col("period"), -4).alias("year_ago"), periods.shift_month(F.col("m"), -3).alias("month_back"), periods.available_on(F.col("period")).alias("available"))


@query(r"""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN CAST(o_custkey AS DOUBLE) WHEN o_orderkey % 5 = 2 THEN CAST(-o_custkey AS DOUBLE) WHEN o_orderkey % 5 = 3 THEN NULL ELSE 1234.5 END AS value FROM orders
""")
def number_cleaning(spark, sf_dir):
    """Numbers written for people: thousands marks, dashes and N/A."""
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, "-").when(k == 1, F.format_number("o_custkey", 0)).when(k == 2, F.concat(F.lit("-"), F.col("o_custkey").cast("string"))).when(k == 3, "N/A").otherwise(" 1,234.5 ")
    return table(spark, sf_dir, "orders").select("o_orderkey", names.number(raw).cast("double").alias("value"))


@query("""
WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS n FROM part),
u AS (SELECT p_partkey, n, list_filter(range(1, len(n) + 1), lambda i: list_position(n, n[i]) = i) AS first FROM t)
SELECT p_partkey, array_to_string(list_transform(first, lambda i: n[i]), '|') AS names, CASE p_partkey % 4 WHEN 1 THEN 2 ELSE 0 END AS extra, p_partkey % 4 = 2 AS more FROM u
""")
def consortium_members(spark, sf_dir):
    """Members of consortia written in several ways: names once each, uncounted and counted others."""
    form = F.element_at(F.array(*map(F.lit, (" 컨소시엄", " 외 2개사", " 등", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    first = F.get(F.split("p_name", " "), F.lit(0))
    raw = F.concat(F.regexp_replace("p_name", " ", "(주), "), F.lit(" , ㈜"), first, form)
    # a small file is one task; what is done to a row is worth more of them
    parts = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    s = parts.select("p_partkey", names.consortium(F.col("raw")).alias("c"))
    bare = F.transform("c.names", lambda x: F.regexp_replace(x, r"\(주\)|㈜", ""))
    return s.select("p_partkey", F.array_join(bare, "|").alias("names"), "c.extra", "c.more")
