"""Relational report queries, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import relational as R
from millrace.plans.registry import query
from millrace.sources.tables import table


def _t(spark, sf_dir, *names):
    found = [table(spark, sf_dir, n) for n in names]
    return found[0] if len(found) == 1 else found


def _n():
    return F.count(F.lit(1))


@query("event_funnel", """SELECT user_id, count(*)::BIGINT AS events, count(*) FILTER (WHERE event_type = 'view')::BIGINT AS views, count(*) FILTER (WHERE event_type = 'click')::BIGINT AS clicks,
  count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS purchases, round(coalesce(count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_type = 'click'), 0), -1), 9) AS rate FROM events GROUP BY user_id""")
def event_funnel(spark, sf_dir):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    rate = F.round(F.coalesce(F.try_divide(kind("purchase"), kind("click")), F.lit(-1.0)), 9)
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(_n().alias("events"), kind("view").alias("views"), kind("click").alias("clicks"), kind("purchase").alias("purchases"), rate.alias("rate"))


@query("zero_group_counts", "SELECT n_name, count(c_custkey)::BIGINT AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 AND c_mktsegment = 'BUILDING' GROUP BY n_name")
def zero_group_counts(spark, sf_dir):
    nation, customer = _t(spark, sf_dir, "nation", "customer")
    counts = customer.where("c_acctbal > 9000 AND c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(_n().alias("n"))
    return R.zero_filled(counts, nation.select("n_nationkey", "n_name"), "n_nationkey", "n").select("n_name", "n")


@query("ordered_json_list", "SELECT c_nationkey, list(c_custkey || ':' || c_mktsegment ORDER BY c_custkey)::VARCHAR[] AS members FROM customer GROUP BY c_nationkey")
def ordered_json_list(spark, sf_dir):
    rows = F.sort_array(F.collect_list(F.struct("c_custkey", "c_mktsegment")))
    return _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.transform(rows, lambda r: F.concat_ws(":", r["c_custkey"], r["c_mktsegment"])).alias("members"))


@query("json_object_counts", "SELECT c_nationkey, string_agg(c_mktsegment || '=' || n, ',' ORDER BY c_mktsegment) AS object FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def json_object_counts(spark, sf_dir):
    counts = _t(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(_n().alias("n"))
    objects = counts.groupBy("c_nationkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("c_mktsegment", "n")))).alias("m"))
    return objects.select("c_nationkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("object"))


@query("string_agg_distinct", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, count(DISTINCT o_orderstatus)::BIGINT AS statuses FROM orders GROUP BY o_custkey")
def string_agg_distinct(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"), F.count_distinct("o_orderstatus").alias("statuses"))


@query("lateral_stats", "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_orders, round(total, 2) AS total, last_date FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_orderdate) AS last_date FROM orders WHERE o_custkey = c_custkey HAVING count(*) > 0) ON TRUE")
def lateral_stats(spark, sf_dir):
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    joined = R.with_stats(customer.select("c_custkey"), orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], _n().alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_orderdate").alias("last_date"))
    return joined.select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"), F.round("total", 2).alias("total"), "last_date")


@query("latest_child", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def latest_child(spark, sf_dir):
    return R.latest(_t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey", "o_orderkey", "o_orderstatus")


@query("recent_rate", "SELECT event_type, round(avg(value), 6) AS recent_mean, count(*)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20 GROUP BY event_type")
def recent_rate(spark, sf_dir):
    return R.recent_mean(_t(spark, sf_dir, "events"), ["event_type"], "ts", "event_id", "value").select("event_type", F.round("recent_mean", 6).alias("recent_mean"), "n")


@query("distinct_on_preference", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, (o_orderpriority LIKE '1%') DESC, o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def distinct_on_preference(spark, sf_dir):
    order = [F.desc(F.col("o_orderstatus") == "F"), F.desc(F.col("o_orderpriority").startswith("1")), F.desc("o_orderdate"), F.col("o_orderkey")]
    return R.prefer(_t(spark, sf_dir, "orders"), ["o_custkey"], order).select("o_custkey", "o_orderkey")


@query("top_n_per_group", "SELECT l_suppkey, l_partkey, round(rev, 4) AS revenue, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(rev, 4) DESC, l_partkey) AS k FROM (SELECT l_suppkey, l_partkey, sum(l_extendedprice * (1 - l_discount)) AS rev FROM lineitem GROUP BY ALL)) WHERE k <= 3")
def top_n_per_group(spark, sf_dir):
    revenue = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))
    return R.top_n(revenue, ["l_suppkey"], [F.desc("revenue"), F.col("l_partkey")], 3)


@query("anti_join_missing", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_missing(spark, sf_dir):
    customer, orders = _t(spark, sf_dir, "customer", "orders")
    return customer.join(orders, customer.c_custkey == orders.o_custkey, "left_anti").select("c_custkey")


@query("semi_join_scope", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semi_join_scope(spark, sf_dir):
    customer, orders, nation = _t(spark, sf_dir, "customer", "orders", "nation")
    rich = customer.join(orders.where("o_totalprice > 400000"), customer.c_custkey == orders.o_custkey, "left_semi")
    return rich.join(nation.where("n_regionkey = 1"), rich.c_nationkey == nation.n_nationkey, "left_semi").select("c_custkey", "c_name")


@query("composite_semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
def composite_semi_join(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    twice = lines.groupBy("l_partkey", "l_suppkey").agg(_n().alias("n")).where("n > 1")
    return lines.join(twice, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query("star_join_report", """SELECT r_name, year(o_orderdate)::INT AS year, count(*)::BIGINT AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_join_report(spark, sf_dir):
    lines, orders, customer, nation, region = _t(spark, sf_dir, "lineitem", "orders", "customer", "nation", "region")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return joined.groupBy("r_name", F.year("o_orderdate").alias("year")).agg(_n().alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("chunk_neighbours", "SELECT a.conv_id, a.turn AS source, b.turn AS neighbour, CASE WHEN abs(a.turn - b.turn) <= 2 THEN 'near' ELSE 'far' END AS kind, abs(a.turn - b.turn)::BIGINT AS distance FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) BETWEEN 1 AND 6")
def chunk_neighbours(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("item"))
    return R.neighbours(turns, "conv_id", "turn", "item").withColumn("distance", F.col("distance").cast("long"))


@query("chunk_links", "SELECT l_orderkey, l_linenumber, lag(l_partkey) OVER w AS previous, lead(l_partkey) OVER w AS next, (row_number() OVER w - 1)::INT AS place FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)")
def chunk_links(spark, sf_dir):
    return R.linked(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey").drop("l_partkey", "l_suppkey")


@query("same_group_relations", "SELECT a.conv_id, a.turn AS source, b.turn AS target, CASE WHEN a.role = b.role THEN 'same_section' ELSE 'same_document' END AS kind FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn")
def same_group_relations(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    other = turns.select("conv_id", F.col("turn").alias("target"), F.col("role").alias("r2"))
    pairs = turns.join(other, "conv_id").where(F.col("turn") != F.col("target"))
    return pairs.select("conv_id", F.col("turn").alias("source"), "target", F.when(F.col("role") == F.col("r2"), "same_section").otherwise("same_document").alias("kind"))


SQL_COOC = """t AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
p AS (SELECT a.l_suppkey AS seed, b.l_suppkey AS related, count(*) AS shared FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL),
s AS (SELECT *, round(least(0.95, 0.62 + ln(shared + 1) * 0.07), 9) AS score FROM p)"""


def _cooccurrence(spark, sf_dir):
    return R.cooccurrence(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 0.95, 0.62, 0.07).withColumn("score", F.round("score", 9))


@query("cooccurrence_relations", f"WITH {SQL_COOC}, r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, shared DESC, related) AS rank FROM s) SELECT seed, related, shared::BIGINT AS shared, score, rank::INT AS rank FROM r WHERE rank <= 5")
def cooccurrence_relations(spark, sf_dir):
    return R.top_n(_cooccurrence(spark, sf_dir), ["seed"], [F.desc("score"), F.desc("shared"), F.col("related")], 5).select("seed", "related", "shared", "score", "rank")


@query("alias_bidirectional", "SELECT a AS seed, b AS related, greatest(0, least(1, max(s))) AS score FROM (SELECT p_brand AS a, p_type AS b, p_size / 40.0 AS s FROM part UNION ALL SELECT p_type, p_brand, p_size / 40.0 FROM part) GROUP BY ALL")
def alias_bidirectional(spark, sf_dir):
    pairs = _t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("seed"), F.col("p_type").alias("related")).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max(F.col("p_size") / 40.0))).alias("score"))
    return R.both_ways(pairs).select("seed", "related", "score")


@query("recent_window_counts", "SELECT event_type, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY)::BIGINT AS last_7_days, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY)::BIGINT AS last_30_days FROM events GROUP BY event_type")
def recent_window_counts(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    dated = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))  # one row
    within = lambda d: F.count_if(F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {d} DAYS"))
    return dated.groupBy("event_type").agg(within(7).alias("last_7_days"), within(30).alias("last_30_days"))


@query("json_value_stats", "SELECT event_type, round(avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) / 5, 6) AS mean_fifth, sum(coalesce(TRY_CAST(json_extract_string(props, '$.missing') AS BIGINT), TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)))::BIGINT AS total FROM events GROUP BY event_type")
def json_value_stats(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    total = F.sum(F.coalesce(F.get_json_object("props", "$.missing").try_cast("long"), k.try_cast("long")))
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(k.try_cast("double")) / 5, 6).alias("mean_fifth"), total.alias("total"))


@query("single_value_inference", "SELECT o_custkey, min(o_orderstatus) AS status FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1")
def single_value_inference(spark, sf_dir):
    found = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("status"), F.max("o_orderstatus").alias("_m"))
    return found.where("status = _m").drop("_m")


@query("upsert_actions", """WITH o AS (SELECT c_custkey AS k, c_nationkey AS v, c_mktsegment AS s FROM customer), n AS (SELECT o_custkey AS k, max(CASE WHEN o_orderstatus = 'F' THEN c_nationkey ELSE c_nationkey + 1 END) AS v, any_value(c_mktsegment) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
  UNION ALL SELECT -s_suppkey - 1, s_nationkey, 'NEW' FROM supplier)
SELECT k, CASE WHEN o.v IS NULL THEN 'inserted' WHEN n.v IS NULL THEN 'kept' WHEN o.v IS NOT DISTINCT FROM n.v AND o.s IS NOT DISTINCT FROM n.s THEN 'skipped' ELSE 'updated' END AS action FROM o FULL JOIN n USING (k)""")
def upsert_actions(spark, sf_dir):
    customer, orders, supplier = _t(spark, sf_dir, "customer", "orders", "supplier")
    old = customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"), F.col("c_mktsegment").alias("s"))
    seen = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy(F.col("c_custkey").alias("k")).agg(
        F.max(F.when(F.col("o_orderstatus") == "F", F.col("c_nationkey")).otherwise(F.col("c_nationkey") + 1)).alias("v"), F.first("c_mktsegment").alias("s"))
    new = seen.unionByName(supplier.select((-F.col("s_suppkey") - 1).alias("k"), F.col("s_nationkey").alias("v"), F.lit("NEW").alias("s")))
    return R.upsert_actions(old, new, ["k"], ["v", "s"])


@query("cascade_delete", "SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) GROUP BY l_returnflag")
def cascade_delete(spark, sf_dir):
    lines, orders, customer = _t(spark, sf_dir, "lineitem", "orders", "customer")
    doomed = orders.join(customer.where("c_acctbal < 0"), orders.o_custkey == customer.c_custkey, "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.deleted(lines, doomed, ["l_orderkey"]).groupBy("l_returnflag").agg(_n().alias("n"))


@query("optional_filter_page", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#2' ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 5")
def optional_filter_page(spark, sf_dir):
    found = R.optional_filter(_t(spark, sf_dir, "part"), p_brand="Brand#2", p_type=None)
    return R.page(found, [F.desc("p_retailprice"), F.col("p_partkey")], 10, 5).select("p_partkey", "p_name")


def _epoch_ms(ts):
    """Milliseconds since 1970 of a time without a zone, halves away from zero, whatever the session's zone and its summer time."""
    seconds = (ts - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).cast("interval second").cast("decimal(20,6)")
    return F.round(seconds * 1000).cast("long")


@query("eta_ladder", """WITH a AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS done, epoch_ms(max(ts)) - epoch_ms(min(ts)) AS ms FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN done = total THEN 'finished' WHEN done = 0 THEN 'pending' ELSE 'running' END AS state, CASE WHEN done = total THEN 0 WHEN done = 0 THEN NULL ELSE greatest(0, round((total - done) * (ms / 1000.0 / done)))::BIGINT END AS eta FROM a""")
def eta_ladder(spark, sf_dir):
    work = _t(spark, sf_dir, "events").groupBy("user_id").agg(_n().alias("total"), F.count_if(F.col("event_type") != "error").alias("done"), (_epoch_ms(F.max("ts")) - _epoch_ms(F.min("ts"))).alias("ms"))
    state = F.when(F.col("done") == F.col("total"), "finished").when(F.col("done") == 0, "pending").otherwise("running")
    eta = F.when(F.col("done") == F.col("total"), F.lit(0).cast("long")).when(F.col("done") > 0, F.greatest(F.lit(0).cast("long"), F.round((F.col("total") - F.col("done")) * (F.col("ms") / 1000.0 / F.col("done"))).cast("long")))
    return work.select("user_id", state.alias("state"), eta.alias("eta"))


@query("union_distinct_scope", "SELECT key, kind FROM (SELECT c_nationkey AS key, 'nation' AS kind FROM customer UNION SELECT s_nationkey, 'nation' FROM supplier UNION SELECT n_regionkey, 'region' FROM nation)")
def union_distinct_scope(spark, sf_dir):
    customer, supplier, nation = _t(spark, sf_dir, "customer", "supplier", "nation")
    rows = [customer.select(F.col("c_nationkey").alias("key"), F.lit("nation").alias("kind")), supplier.select("s_nationkey", F.lit("nation")), nation.select("n_regionkey", F.lit("region"))]
    return rows[0].union(rows[1]).union(rows[2]).distinct()


@query("label_quality_report", "SELECT source, count(*)::BIGINT AS labelled, count(*) FILTER (WHERE quality = 1)::BIGINT AS good, round(count(*) FILTER (WHERE toxic = 1) / count(*), 9) AS noise FROM documents JOIN labels USING (doc_id) GROUP BY source")
def label_quality_report(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents", "labels")
    return docs.select("doc_id", "source").join(labels, "doc_id").groupBy("source").agg(_n().alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.round(F.count_if(F.col("toxic") == 1) / _n(), 9).alias("noise"))


@query("readiness_counts", "SELECT count(*)::BIGINT AS total, count(l.doc_id)::BIGINT AS materialised, max(n_chars)::BIGINT AS longest FROM documents d LEFT JOIN labels l USING (doc_id)")
def readiness_counts(spark, sf_dir):
    docs, labels = _t(spark, sf_dir, "documents", "labels")
    joined = docs.select("doc_id", "n_chars").join(labels.select("doc_id", F.lit(1).alias("m")), "doc_id", "left")
    return joined.agg(_n().alias("total"), F.count("m").alias("materialised"), F.max("n_chars").alias("longest"))


@query("section_running_index", "SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS running FROM documents")
def section_running_index(spark, sf_dir):
    return R.running(_t(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars").drop("n_chars")


@query("fingerprint_dedup", "SELECT min(doc_id) AS kept, count(*)::BIGINT AS copies, md5(text) AS fingerprint FROM documents GROUP BY text HAVING count(*) > 1")
def fingerprint_dedup(spark, sf_dir):
    keyed = _t(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("fingerprint"), F.xxhash64("text").alias("h"))
    return keyed.groupBy("fingerprint", "h").agg(F.min("doc_id").alias("kept"), _n().alias("copies")).where("copies > 1").select("kept", "copies", "fingerprint")


@query("dataset_quota_sampling", """WITH h AS (SELECT doc_id, lang, md5('7:' || doc_id) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS k FROM h)
SELECT doc_id, lang, CASE WHEN k <= 20 THEN 'dev' ELSE 'test' END AS split FROM r WHERE k <= 40""")
def dataset_quota_sampling(spark, sf_dir):
    """A sampling operator: 40 documents of each category in a seeded order, the first half for dev."""
    hashed = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")).alias("h"))
    return R.top_n(hashed, ["lang"], [F.col("h"), F.col("doc_id")], 40, "k").select("doc_id", "lang", F.when(F.col("k") <= 20, "dev").otherwise("test").alias("split"))


@query("pair_audit", """SELECT p.o_orderkey, CASE WHEN q.o_orderkey IS NULL THEN 'unpaired' WHEN p.o_orderpriority <> q.o_orderpriority THEN 'differs' ELSE 'ok' END AS verdict FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') p LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') q ON q.o_orderkey = p.o_orderkey + 1""")
def pair_audit(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    right = orders.where("o_orderstatus = 'O'").select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderpriority").alias("other"))
    joined = orders.where("o_orderstatus = 'F'").join(right, "o_orderkey", "left")
    return joined.select("o_orderkey", F.when(F.col("other").isNull(), "unpaired").when(F.col("other") != F.col("o_orderpriority"), "differs").otherwise("ok").alias("verdict"))


@query("row_audit", "SELECT split, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE bad)::BIGINT AS n_bad FROM (SELECT CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'other' END AS split, text IS NULL OR trim(text) = '' OR length(text) > 2000 OR turn < 0 AS bad FROM conversations) GROUP BY split")
def row_audit(spark, sf_dir):
    bad = F.col("text").isNull() | (F.trim("text") == "") | (F.length("text") > 2000) | (F.col("turn") < 0)
    split = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("other")
    return _t(spark, sf_dir, "conversations").groupBy(split.alias("split")).agg(_n().alias("n_rows"), F.count_if(bad).alias("n_bad"))
