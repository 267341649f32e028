"""Queries of time series, reports, retrieval and sinks over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.operators import analytics as an
from docgraph.plans.registry import query, table
from docgraph.sinks import writers

KEYS, ORDER = ["user_id"], ["ts", "event_id"]
W = "PARTITION BY user_id ORDER BY ts, event_id"


def series(spark: SparkSession, d: str) -> DataFrame:
    """Every user's purchases and other values as a series of prices."""
    return table(spark, d, "events").where("value IS NOT NULL").select("user_id", "event_id", "ts", "value")


S = "(SELECT user_id, event_id, ts, value FROM events WHERE value IS NOT NULL)"


def rounded(df: DataFrame, *names: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in names})


@query("t01_difference", f"SELECT event_id, round(value - lag(value) OVER ({W}), 6) AS diff FROM {S}")
def t01(spark: SparkSession, d: str) -> DataFrame:
    return rounded(an.difference(series(spark, d), "value", KEYS, ORDER), "diff").select("event_id", "diff")


S_RSI = (
    f"(SELECT *, CASE WHEN n < 14 THEN NULL WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0 END ELSE 100 - 100 / (1 + g / l) END AS rsi FROM ("
    f"SELECT *, count(*) OVER w AS n, avg(gain) OVER w AS g, avg(loss) OVER w AS l FROM (SELECT *, CASE WHEN d > 0 THEN d ELSE 0.0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS loss FROM (SELECT *, value - lag(value) OVER ({W}) AS d FROM {S})) "
    f"WINDOW w AS ({W} ROWS 13 PRECEDING)))"
)


@query("t02_rsi", f"SELECT event_id, round(rsi, 6) AS rsi FROM {S_RSI}")
def t02(spark: SparkSession, d: str) -> DataFrame:
    return rounded(an.rsi(series(spark, d), "value", KEYS, ORDER), "rsi").select("event_id", "rsi")


def _s_sma(n: int) -> str:
    return f"round(CASE WHEN count(value) OVER ({W} ROWS {n - 1} PRECEDING) = {n} THEN avg(value) OVER ({W} ROWS {n - 1} PRECEDING) END, 6) AS sma{n}"


@query("t03_moving_averages", f"SELECT event_id, {_s_sma(5)}, {_s_sma(20)}, {_s_sma(60)} FROM {S}")
def t03(spark: SparkSession, d: str) -> DataFrame:
    return rounded(an.moving_averages(series(spark, d), "value", KEYS, ORDER), "sma5", "sma20", "sma60").select("event_id", "sma5", "sma20", "sma60")


@query(
    "t04_macd",
    f"WITH RECURSIVE s AS (SELECT *, row_number() OVER ({W}) AS i FROM {S}), "
    "e AS (SELECT user_id, event_id, i, value AS f, value AS s, 0.0::DOUBLE AS sig FROM s WHERE i = 1 UNION ALL "
    "SELECT s.user_id, s.event_id, s.i, 2.0/13 * s.value + 11.0/13 * e.f, 2.0/27 * s.value + 25.0/27 * e.s, 0.2 * ((2.0/13 * s.value + 11.0/13 * e.f) - (2.0/27 * s.value + 25.0/27 * e.s)) + 0.8 * e.sig FROM e JOIN s ON s.user_id = e.user_id AND s.i = e.i + 1) "
    "SELECT event_id, round(f - s, 4) AS macd, round(sig, 4) AS macd_signal, round(f - s - sig, 4) AS macd_hist FROM e",
)
def t04(spark: SparkSession, d: str) -> DataFrame:
    return rounded(an.macd(series(spark, d), "value", KEYS, ORDER), "macd", "macd_signal", "macd_hist", n=4).select("event_id", "macd", "macd_signal", "macd_hist")


S_BB = f"(SELECT *, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM {S} WINDOW w AS ({W} ROWS 19 PRECEDING))"


@query("t05_bollinger", f"SELECT event_id, round(CASE WHEN n = 20 THEN m END, 5) AS bb_mid, round(CASE WHEN n = 20 THEN m + 2 * sd END, 5) AS bb_upper, round(CASE WHEN n = 20 THEN m - 2 * sd END, 5) AS bb_lower FROM {S_BB}")
def t05(spark: SparkSession, d: str) -> DataFrame:
    return rounded(an.bollinger(series(spark, d), "value", KEYS, ORDER), "bb_mid", "bb_upper", "bb_lower", n=5).select("event_id", "bb_mid", "bb_upper", "bb_lower")


@query("t06_screen", f"SELECT user_id, event_id, round(rsi, 6) AS rsi, CASE WHEN rsi < 30 THEN 'BUY' WHEN rsi > 70 THEN 'SELL' ELSE 'HOLD' END AS signal FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {S_RSI}) WHERE r = 1")
def t06(spark: SparkSession, d: str) -> DataFrame:
    return rounded(an.screen(an.rsi(series(spark, d), "value", KEYS, ORDER), KEYS, ORDER), "rsi").select("user_id", "event_id", "rsi", "signal")


@query("t07_score_card")
def t07(spark: SparkSession, d: str) -> DataFrame:
    s = series(spark, d).withColumn("volume", F.col("event_id") % 97)
    return an.score_card(s, "value", "volume", KEYS, ORDER).select("event_id", "score", "grade")


@query("t08_events_join", "SELECT o_orderkey, coalesce(s, 0) AS qty FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey")
def t08(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("qty"))
    return an.with_events(table(spark, d, "orders").select("o_orderkey"), q, ["o_orderkey"], ["qty"])


@query("t09_coerce", "SELECT event_id, CAST(make_timestamp(CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 1000000) AS DATE) AS date, round(value, 4) AS value, CAST(user_id AS BIGINT) AS volume FROM events")
def t09(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("epoch"), F.col("value").cast("string").alias("value"), F.col("user_id").cast("string").alias("volume"))
    return an.coerce_prices(e, "epoch", ["value"], "volume").select("event_id", "date", "value", "volume")


@query("t10_non_zero", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount <> 0")
def t10(spark: SparkSession, d: str) -> DataFrame:
    return an.non_zero(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), "l_discount")


@query(
    "t11_latest_change",
    f"SELECT user_id, round(value, 6) AS value, round(CASE WHEN p IS NULL OR p = 0 THEN 0.0 ELSE (value - p) / abs(p) * 100 END, 4) AS change_pct FROM (SELECT *, lag(value) OVER ({W}) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {S}) WHERE r = 1",
)
def t11(spark: SparkSession, d: str) -> DataFrame:
    out = an.latest_change(series(spark, d), "value", KEYS, ORDER).select("user_id", F.round("value", 6).alias("value"), "change_pct")
    return rounded(out, "change_pct", n=4)


TYPES = ["view", "signup", "purchase", "error", "click"]


@query("t12_pivot", "SELECT user_id, " + ", ".join(f"arg_min(value, event_id) FILTER (WHERE event_type = '{t}' AND value IS NOT NULL) AS \"{t}\"" for t in TYPES) + " FROM events WHERE value IS NOT NULL GROUP BY user_id")
def t12(spark: SparkSession, d: str) -> DataFrame:
    return an.to_wide(table(spark, d, "events").where("value IS NOT NULL"), ["user_id"], "event_type", "value", TYPES, "event_id")


@query(
    "t13_statement",
    "WITH s AS (SELECT c_mktsegment AS account, CAST(year(o_orderdate) AS VARCHAR) AS p, o_totalprice AS v, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) SELECT account, "
    + ", ".join(f"format('{{:,}}', CAST(round(arg_max(v, o_orderkey) FILTER (WHERE p = '{y}') / 10) AS BIGINT)) AS \"{y}\", format('{{:,}}', CAST(round(arg_max(v * 2, o_orderkey) FILTER (WHERE p = '{y}') / 10) AS BIGINT)) AS \"{y}(+)\"" for y in (1995, 1996))
    + " FROM s GROUP BY account",
)
def t13(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = o.select(F.col("c_mktsegment").alias("account"), F.year("o_orderdate").cast("string").alias("p"), F.col("o_totalprice").alias("v"), (F.col("o_totalprice") * 2).alias("v2"), "o_orderkey")
    return an.statement_pivot(s, "account", "p", "v", "v2", "o_orderkey", ["1995", "1996"], 10)


@query("t14_split_concat", "SELECT o_orderkey, o_orderstatus, 'status ' || o_orderstatus AS part FROM orders WHERE o_orderstatus IS NOT NULL")
def t14(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    parts = an.split_by(o, "o_orderstatus", [r[0] for r in o.select("o_orderstatus").where("o_orderstatus IS NOT NULL").distinct().collect()])
    return an.concat({f"status {k}": v for k, v in parts.items()}, "part")


@query("t15_sorted", "SELECT n_regionkey, n_name, n_nationkey FROM nation ORDER BY n_regionkey DESC, n_name DESC, n_nationkey")
def t15(spark: SparkSession, d: str) -> DataFrame:
    return an.sorted_rows(table(spark, d, "nation"), [("n_regionkey", False), ("n_name", False), ("n_nationkey", True)]).select("n_regionkey", "n_name", "n_nationkey")


@query("t16_transpose", "SELECT 'n_accounts' AS name, " + ", ".join(f"CAST(count(*) FILTER (WHERE c_mktsegment = '{s}') AS VARCHAR) AS \"{s}\"" for s in ("BUILDING", "MACHINERY")) + " FROM customer UNION ALL SELECT 'n_nations', " + ", ".join(f"CAST(count(DISTINCT c_nationkey) FILTER (WHERE c_mktsegment = '{s}') AS VARCHAR)" for s in ("BUILDING", "MACHINERY")) + " FROM customer")
def t16(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n_accounts"), F.countDistinct("c_nationkey").alias("n_nations"))
    return an.transpose(c, "c_mktsegment", ["n_accounts", "n_nations"], ["BUILDING", "MACHINERY"])


@query(
    "t17_top_share",
    "WITH t AS (SELECT l_suppkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT l_suppkey, round(v, 2) AS v, CAST(row_number() OVER (ORDER BY v DESC, l_suppkey) AS INTEGER) AS rank, round(v / (SELECT sum(v) FROM t) * 100, 6) AS share FROM t ORDER BY v DESC, l_suppkey LIMIT 10",
)
def t17(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    return rounded(rounded(an.top_share(t, "v", "l_suppkey"), "share"), "v", n=2)


def _periods(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return an.compare_periods(o.where("y = 1996"), o.where("y = 1995"), ["o_custkey"], "v")


S_T18 = (
    "(WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.v AS new_value, b.v AS old_value, "
    "CASE WHEN b.v IS NULL THEN 'NEW' WHEN a.v IS NULL THEN 'CLOSED' WHEN a.v > b.v THEN 'INCREASED' WHEN a.v < b.v THEN 'DECREASED' ELSE 'SAME' END AS status, round(coalesce(a.v, 0) - coalesce(b.v, 0), 2) AS change, "
    "round(CASE WHEN a.v IS NULL OR b.v IS NULL THEN NULL WHEN b.v = 0 THEN 0.0 ELSE (a.v - b.v) / abs(b.v) * 100 END, 6) AS change_pct FROM (SELECT * FROM o WHERE y = 1996) a FULL JOIN (SELECT * FROM o WHERE y = 1995) b ON a.o_custkey = b.o_custkey)"
)


@query("t18_compare", f"SELECT * FROM {S_T18}")
def t18(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(_periods(spark, d), "change_pct"), "change", n=2)


@query("t18_top_movers", f"(SELECT o_custkey, change_pct FROM {S_T18} WHERE status = 'INCREASED' ORDER BY change_pct DESC, o_custkey LIMIT 20) UNION ALL (SELECT o_custkey, change_pct FROM {S_T18} WHERE status = 'DECREASED' ORDER BY change_pct, o_custkey LIMIT 20)")
def t18_top(spark: SparkSession, d: str) -> DataFrame:
    return an.top_movers(rounded(_periods(spark, d), "change_pct"), "o_custkey").select("o_custkey", "change_pct")


@query("t19_growth", "WITH o AS (SELECT c_nationkey, year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_nationkey, CAST(y AS INTEGER) AS y, round((v - lag(v) OVER w) / nullif(abs(lag(v) OVER w), 0) * 100, 6) AS yoy_pct FROM o WINDOW w AS (PARTITION BY c_nationkey ORDER BY y)")
def t19(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return rounded(an.growth(g, "v", ["c_nationkey"], ["y"]), "yoy_pct").select("c_nationkey", "y", "yoy_pct")


@query("t20_peers", "SELECT s_nationkey, coalesce(arg_min(s_acctbal, s_suppkey) FILTER (WHERE s_acctbal > 5000), arg_min(s_acctbal, s_suppkey)) AS s_acctbal FROM supplier GROUP BY 1")
def t20(spark: SparkSession, d: str) -> DataFrame:
    return an.chosen_or_first(table(spark, d, "supplier"), ["s_nationkey"], F.col("s_acctbal") > 5000, "s_acctbal", "s_suppkey")


@query("t21_price_history", "SELECT CAST(o_orderdate AS DATE) AS date, floor(o_totalprice) AS close, CAST(o_custkey AS BIGINT) AS volume FROM orders WHERE o_orderkey % 7 <= 5 AND o_orderkey % 5 <> 0 AND CAST(o_orderdate AS DATE) >= DATE '1995-01-01'")
def t21(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").select((F.col("o_orderkey") % 7).alias("page"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy.MM.dd")).alias("date"), F.format_number(F.floor("o_totalprice"), 0).alias("close"), F.col("o_custkey").cast("string").alias("volume"))
    return an.price_history(p, "1995-01-01", 5)


@query("t22_recent", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' - INTERVAL 90 DAY AND TIMESTAMP '1997-01-01'")
def t22(spark: SparkSession, d: str) -> DataFrame:
    return an.recent(table(spark, d, "orders"), "o_orderdate", "1997-01-01", 90).select("o_orderkey")


@query("t23_lookup", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)an') ORDER BY p_name, p_partkey LIMIT 10")
def t23(spark: SparkSession, d: str) -> DataFrame:
    return an.lookup(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "an", "p_partkey")


S_DIST = "1 - sqrt(list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))))"


@query("e01_knn", f"WITH s AS (SELECT a.vec_id, round({S_DIST}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s ORDER BY score DESC, vec_id LIMIT 5")
def e01(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return an.nearest(e, list(e.where("vec_id = 0").first()["embedding"]), 5)


@query("e01_knn_batch", f"WITH s AS (SELECT q.vec_id AS query_id, a.vec_id, round(round({S_DIST}, 6), 5) AS score FROM embeddings a, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) q WHERE a.vec_id <> q.vec_id) SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5")
def e01_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return an.nearest_batch(e, e.where("vec_id % 50 = 0"), 5, itself=False, digits=5)


@query("e02_sql", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def e02(spark: SparkSession, d: str) -> DataFrame:
    return an.sql(spark, "SELECT c_custkey, c_name FROM e02_customer WHERE c_acctbal > :least", {"e02_customer": table(spark, d, "customer")}, least=5000)


@query("e05_prompt", "SELECT 'Context:' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY item_id) || chr(10) || chr(10) || 'Question: why?' || chr(10) || 'Answer:' AS prompt FROM (SELECT * FROM benchmark ORDER BY length(text), item_id LIMIT 5)")
def e05(spark: SparkSession, d: str) -> DataFrame:
    return an.rag_prompt(table(spark, d, "benchmark").orderBy(F.length("text"), "item_id").limit(5), "why?", "text", ["item_id"])


@query("l09_warehouse", "SELECT 'n' || doc_id AS node_id, 'Text' AS node_class, coalesce(text, '') AS content, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS checksum FROM documents")
def l09(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select(F.concat(F.lit("n"), "doc_id").alias("node_id"), F.lit("Text").alias("node_class"), F.col("text").alias("content"))
    return writers.warehouse_rows(n).drop("schema_text")


@query("l11_sanitize", "SELECT c_custkey, '{\"n\":' || c_nationkey || '}' AS nested FROM customer")
def l11(spark: SparkSession, d: str) -> DataFrame:
    return writers.sanitize(table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_nationkey").alias("n")).alias("nested")))


@query("l12_upsert", "SELECT c_custkey, coalesce(v, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def l12(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), "o_orderkey")
    return an.upsert(table(spark, d, "customer").select("c_custkey", "c_acctbal"), o, ["c_custkey"], "o_orderkey")
