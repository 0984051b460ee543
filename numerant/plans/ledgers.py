"""Queries over stores, transcripts, evaluations and event streams (in their batch form)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numerant.operators.claims import order_blocks, order_claims
from numerant.operators.evaluation import arm_matrix, arm_summary, missing_and_wrong
from numerant.operators.ledger import captions, forward_filled, missing, upserted
from numerant.operators.status import figure_statuses
from numerant.operators.turns import attempts, latest, selected_answers, year_hints
from numerant.sources.tables import spread, table
from numerant.streaming.windows import deduplicated, session_totals, tumbling_totals


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def q19_unit_row_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of a table per user: a purchase sets the unit of the rows below it."""
    unit = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return forward_filled(_events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")], unit, "unit_from").select("event_id", "unit_from")


def q20_caption_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages: for each answer (a table) the nearest message above it, after the last answer, that is longer than 200 characters."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = captions(rows, "conv_id", [F.col("turn")], F.col("role") == "assistant", F.length("text") > 200, F.col("turn").cast("string"))
    return found.filter("role = 'assistant'").select("conv_id", "turn", "caption")


def q21_nearest_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as figures and years of a clause, at places made from their numbers."""
    rows = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_orderkey")
    items = rows.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 12).alias("start"), (F.col("l_linenumber") * 12 + 4).alias("stop"), F.year("l_shipdate").alias("year"))
    figures = items.select(F.col("l_orderkey").alias("clause"), F.col("l_linenumber").alias("pos"), "start", "stop")
    years = items.filter("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("clause"), "year", (F.col("start") + 5).alias("y_start"), (F.col("start") + 9).alias("y_stop"))
    return year_hints(figures, years, "clause").select("clause", "pos", "year")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as checks: a question per user and event type, denied for small values."""
    question = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return _events(spark, sf_dir).select("event_id", "ts", question.alias("question"), F.when(F.col("value") < 20, "deny").otherwise("allow").alias("decision"))


def q32_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = attempts(_checks(spark, sf_dir), "question", [F.col("ts"), F.col("event_id")])
    return tried.select("event_id", F.col("attempt").cast("long").alias("attempt"), "decision")


def q33_latest_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = latest(_checks(spark, sf_dir), "question", ["ts", "event_id"])
    return newest.orderBy(F.desc("ts"), F.desc("event_id")).limit(12).select("question", "event_id", "decision")


def q34_evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the parts behind its total, as one line of evidence."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = items.join(parts, "l_partkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_brand"))).alias("e"))
    return lines.select("l_orderkey", F.array_join(F.transform("e", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(": "), x["p_brand"])), "; ").alias("evidence"))


def q35_arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _events(spark, sf_dir).select(F.col("event_type").alias("arm"), F.col("user_id").alias("qid"), F.col("value").alias("seconds"), (F.col("value") >= 20).alias("correct"))
    return arm_summary(runs)


def q36_arm_question_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _events(spark, sf_dir).select(F.col("event_type").alias("arm"), F.col("user_id").alias("qid"), (F.col("value") >= 20).alias("correct"))
    return arm_matrix(runs, ["click", "purchase", "view"])


def q37_missing_and_wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers state the sizes of claims; keys expect the totals: figures that are missing, and such that are wrong."""
    orders = table(spark, sf_dir, "orders")
    stated = order_claims(orders).join(orders.select(F.col("o_orderkey").alias("figure_id"), F.col("o_custkey").alias("qid")), "figure_id")
    expected = order_blocks(orders).join(orders.select(F.col("o_orderkey").alias("block_no"), F.col("o_custkey").alias("qid")), "block_no")
    return missing_and_wrong(stated, expected, "qid")


def q38_select_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    injected = (F.col("role") == "user") & (F.col("turn") > 1) & ((F.col("conv_id") + F.col("turn")) % 3 == 0)
    found = selected_answers(table(spark, sf_dir, "conversations").withColumn("injected", injected))
    return found.select("conv_id", "q_pos", F.md5("question").alias("question"), "a_pos", F.md5("answer").alias("answer"))


def q39_json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return _events(spark, sf_dir).select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def q40_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = upserted(_events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type", "value"), "user_id", [F.col("ts"), F.col("event_id")])
    new = missing(rows, _events(spark, sf_dir).filter("event_type = 'purchase'").select("user_id"), ["user_id"])
    return rows.join(new.select("user_id", F.lit(True).alias("new")), "user_id", "left").select("user_id", "event_id", "event_type", F.coalesce("new", F.lit(False)).alias("new"))


def q41_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tumbling_totals(_events(spark, sf_dir), "1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def q42_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = session_totals(_events(spark, sf_dir), "30 minutes")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 6).alias("total"))


def q43_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(_events(spark, sf_dir), ["user_id", "event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("users"), F.min("event_id").alias("first"))


def q44_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of figures by case and year, with totals of both."""
    orders = table(spark, sf_dir, "orders")
    done = figure_statuses(order_claims(orders), order_blocks(orders))
    return done.rollup("status", "year").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def q45_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that are cited, that are known, and both."""
    orders = table(spark, sf_dir, "orders")
    cited, known = order_claims(orders).filter("block is not null").select("block"), order_blocks(orders).select("block")
    parts = [("both", cited.intersect(known)), ("only_cited", cited.subtract(known)), ("only_known", known.subtract(cited)), ("either", cited.union(known).distinct())]
    out = None
    for name, rows in parts:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.union(one)
    return out


def q46_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    have = customers.join(orders, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("with_orders"))
    lack = customers.join(orders, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("without_orders"))
    return have.join(lack, "c_mktsegment", "full").select("c_mktsegment", F.coalesce("with_orders", F.lit(0)).alias("with_orders"), F.coalesce("without_orders", F.lit(0)).alias("without_orders"))


_STATUSES = """s AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS p, o_orderkey % 8 AS c,
  CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.001 AS DECIMAL(4,3)), 1) AS DOUBLE) AS k FROM orders),
t AS (SELECT *, CASE WHEN c = 7 THEN 'untraced' WHEN c = 6 THEN 'phantom' WHEN c = 0 THEN 'traced'
  WHEN c = 1 AND round(abs(k * 1000 - p), 4) <= least(50, 0.02 * CAST(p AS DOUBLE)) THEN 'traced'
  WHEN c = 2 AND round(abs(k * 1000000 - p), 4) <= least(50000, 0.02 * CAST(p AS DOUBLE)) THEN 'traced' ELSE 'mismatch' END AS status FROM s)"""
_CHECKS = "c AS (SELECT event_id, ts, user_id || ':' || event_type AS question, CASE WHEN value < 20 THEN 'deny' ELSE 'allow' END AS decision FROM events)"

SQL = {
    "q19_unit_row_fill": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unit_from FROM events",
    "q20_caption_asof": """WITH i AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM conversations),
f AS (SELECT *, last_value(CASE WHEN length(text) > 200 AND role <> 'assistant' THEN CAST(turn AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY conv_id, island ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS caption FROM i)
SELECT conv_id, turn, caption FROM f WHERE role = 'assistant'""",
    "q21_nearest_year": """WITH i AS (SELECT l_orderkey AS clause, l_linenumber AS pos, l_linenumber * 12 AS a, l_linenumber * 12 + 4 AS b, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem),
p AS (SELECT f.clause, f.pos, y.year, y.a AS ya, CASE WHEN f.a >= y.a + 9 THEN f.a - (y.a + 9) WHEN f.b <= y.a + 5 THEN y.a + 5 - f.b END AS gap, f.a FROM i f JOIN i y ON f.clause = y.clause AND y.pos % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY clause, ya, year ORDER BY gap, a) AS r FROM p WHERE gap <= 15),
h AS (SELECT clause, pos, CASE WHEN count(DISTINCT year) = 1 THEN max(year) END AS year FROM r WHERE r = 1 GROUP BY ALL)
SELECT i.clause, i.pos, h.year FROM i LEFT JOIN h ON i.clause = h.clause AND i.pos = h.pos""",
    "q32_attempts": f"WITH {_CHECKS} SELECT event_id, row_number() OVER (PARTITION BY question ORDER BY ts, event_id) AS attempt, decision FROM c",
    "q33_latest_per_question": f"WITH {_CHECKS}, r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY ts DESC, event_id DESC) AS r FROM c) SELECT question, event_id, decision FROM r WHERE r = 1 ORDER BY ts DESC, event_id DESC LIMIT 12",
    "q34_evidence_join": "SELECT l_orderkey, string_agg(l_linenumber || ': ' || p_brand, '; ' ORDER BY l_linenumber, p_brand) AS evidence FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey",
    "q35_arm_summary": "SELECT event_type AS arm, count(*) AS runs, count(*) FILTER (WHERE value >= 20) AS correct, round(median(value), 6) AS median_seconds, round(max(value), 6) AS most_seconds, count(DISTINCT user_id) AS questions FROM events GROUP BY ALL",
    "q36_arm_question_matrix": """SELECT user_id AS qid, """ + ", ".join(f"CASE WHEN count(*) FILTER (WHERE event_type = '{a}') > 0 THEN count(*) FILTER (WHERE event_type = '{a}' AND value >= 20) || '/' || count(*) FILTER (WHERE event_type = '{a}') END AS {a}" for a in ("click", "purchase", "view")) + " FROM events GROUP BY ALL",
    "q37_missing_and_wrong": """WITH b AS (SELECT o_orderkey AS k, o_custkey AS qid, CAST(o_totalprice AS DECIMAL(18,2)) AS p, o_orderkey % 8 AS c, CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.001 AS DECIMAL(4,3)), 1) AS DECIMAL(18,2)) AS r FROM orders),
s AS (SELECT *, CASE c WHEN 1 THEN CAST(r * 1000 AS DOUBLE) WHEN 2 THEN CAST(r * 1000000 AS DOUBLE) ELSE CAST(p AS DOUBLE) END AS size, CASE c WHEN 1 THEN 50 WHEN 2 THEN 50000 ELSE 0.005 END AS half FROM b),
t AS (SELECT a.k AS stated, e.k AS expected FROM s a JOIN b e ON a.qid = e.qid AND a.c NOT IN (3, 4, 5) AND round(abs(a.size - CAST(e.p AS DOUBLE)), 4) <= a.half AND round(abs(a.size - CAST(e.p AS DOUBLE)), 4) <= 0.25 * CAST(e.p AS DOUBLE))
SELECT qid, count(*) FILTER (WHERE k NOT IN (SELECT expected FROM t)) AS missing, count(*) FILTER (WHERE k NOT IN (SELECT stated FROM t)) AS wrong FROM b GROUP BY qid""",
    "q38_select_answer": """WITH q AS (SELECT conv_id, max(turn) AS q_pos, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' AND (turn <= 1 OR (conv_id + turn) % 3 > 0) GROUP BY conv_id),
u AS (SELECT conv_id, max(turn) AS said FROM conversations WHERE role = 'user' GROUP BY conv_id),
a AS (SELECT c.conv_id, max(turn) AS a_pos, arg_max(text, turn) AS answer FROM conversations c JOIN u ON c.conv_id = u.conv_id AND turn > said WHERE role = 'assistant' AND trim(coalesce(text, '')) <> '' GROUP BY c.conv_id)
SELECT q.conv_id, q_pos, md5(question) AS question, a_pos, md5(answer) AS answer FROM q LEFT JOIN a ON q.conv_id = a.conv_id""",
    "q39_json_flatten": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL",
    "q40_upsert_latest": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, event_id, event_type, user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS new FROM r WHERE r = 1""",
    "q41_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "q42_session": """WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, session""",
    "q43_dedupe": "WITH d AS (SELECT event_type, user_id, min(event_id) AS e FROM events GROUP BY ALL) SELECT event_type, count(*) AS users, min(e) AS first FROM d GROUP BY ALL",
    "q44_grouping_sets": f"WITH {_STATUSES} SELECT status, year, count(*) AS n, CAST(grouping(status, year) AS BIGINT) AS level FROM t GROUP BY ROLLUP (status, year)",
    "q45_set_ops": "SELECT 'both' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 8 < 6 UNION ALL SELECT 'only_cited', count(*) FROM orders WHERE o_orderkey % 8 = 6 UNION ALL SELECT 'only_known', count(*) FROM orders WHERE o_orderkey % 8 >= 6 UNION ALL SELECT 'either', count(*) + count(*) FILTER (WHERE o_orderkey % 8 = 6) FROM orders",
    "q46_semi_anti": "SELECT c_mktsegment, count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS with_orders, count(*) FILTER (WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without_orders FROM customer GROUP BY ALL",
}

QUERIES = {f.__name__: f for f in (q19_unit_row_fill, q20_caption_asof, q21_nearest_year, q32_attempts, q33_latest_per_question, q34_evidence_join, q35_arm_summary, q36_arm_question_matrix, q37_missing_and_wrong, q38_select_answer, q39_json_flatten, q40_upsert_latest, q41_tumbling, q42_session, q43_dedupe, q44_grouping_sets, q45_set_ops, q46_semi_anti)}
