"""Queries over the store: tables read as blocks, requests, pages, transcripts, ways to write values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numerant.functions.numeric import shown
from numerant.operators.blocks import block_values
from numerant.operators.calculation import renamed
from numerant.operators.claims import amount
from numerant.operators.denials import denials, question_id
from numerant.operators.evaluation import drafts
from numerant.operators.evidence import evidence, evidence_lines
from numerant.operators.exact import exactly
from numerant.operators.ledger import cached, pages_to_read, read_problems
from numerant.operators.retrieval import figures_there
from numerant.operators.results import rewrites, stated_as
from numerant.operators.turns import valid_calculations
from numerant.sources.tables import FINER, dealt, spread, table
from numerant.sources.versions import appended, current, fresh_folder, with_ids, written


def q56_ways_to_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of orders as blocks state them: in several currencies and scales, and in pence."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", amount("o_totalprice").cast("decimal(24,6)").alias("v"), F.when(k % 3 == 0, "USD").when(k % 3 == 1, "CHF").alias("currency"), (k % 4 * 3).cast("int").alias("scale"), F.when(k % 5 == 0, "p").alias("unit"),
    )
    return rows.select("o_orderkey", F.array_join(rewrites(F.col("v"), F.lit(2), F.col("currency"), F.col("scale")), " or ").alias("ways"), stated_as(F.col("unit"), F.col("currency"), F.col("scale")).alias("stated"))


def q57_read_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for pages of documents, most of them faulty in one way."""
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 7 == 1, "").otherwise("/"), F.lit("docs/"), k, F.when(k % 7 == 2, ".txt").otherwise(".PDF"))
    pages = F.when(k % 7 == 3, F.sequence(F.lit(1), F.lit(31))).when(k % 7 == 4, F.array(F.lit(1), F.lit(0))).when(k % 7 == 5, F.array(F.lit(2), F.lit(2)))
    asked = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), pages.alias("pages"), F.when(k % 7 < 6, F.col("p_size")).alias("n_pages"))
    return read_problems(asked).select("p_partkey", "problem")


def q58_pages_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of seven pages, whose items are the pages that were read."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(1), F.lit(7))).alias("pages"), F.lit(7).alias("n_pages"))
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page_index"))
    return pages_to_read(orders, blocks).select("doc_id", F.col("page").cast("long").alias("page"))


def q59_question_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return rows.select("conv_id", "turn", question_id(F.col("conv_id").cast("string"), F.col("turn"), F.col("text")).alias("question"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order as a transcript: a question, then answers, results of tools and denials in turn."""
    n = F.col("l_linenumber")
    role = F.when(n % 3 == 1, "user").when((n + F.col("l_orderkey")) % 2 == 0, "tool").otherwise("assistant")
    text = F.when(role == "tool", F.concat(F.lit("C"), n, F.lit(" = 5%  (write it as: 5% [C"), n, F.lit("])"))).otherwise(F.concat(F.lit("text "), n))
    items = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")
    return items.select(F.col("l_orderkey").alias("conv_id"), n.alias("turn"), role.alias("role"), text.alias("text"), ((n > 1) & (role == "user")).alias("injected"))


def q60_valid_calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_calculations(_messages(spark, sf_dir)).select("conv_id", "calc_id")


def q61_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts(_messages(spark, sf_dir)).select("conv_id", F.col("turn").cast("long").alias("turn"), "draft")


def q62_denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = table(spark, sf_dir, "events").select(F.col("user_id").alias("question"), F.when(F.col("event_type") == "purchase", "deny").otherwise("allow").alias("decision"))
    return denials(checks, "question")


def q63_block_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order: years and a unit in its header, a bracketed loss, a note column, and a row of units."""
    y, p, k = F.year("o_orderdate"), shown(amount("o_totalprice"), 2), F.col("o_orderkey")
    text = F.concat(
        F.lit("| Item | "), y, F.lit(" £m | "), y - 1, F.lit(" £m | Note |\n|---|---|---|---|\n| Total | "), p, F.lit(" | ("), p, F.lit(") | 4 |\n| | pence | pence | |\n| Per share | "), k % 100 + 1, F.lit(".5 | 7 | 5 |"),
    )
    found = block_values(_dealt_orders(spark, sf_dir).select(k.cast("string").alias("block"), text.alias("text")))
    return found.select(F.col("block").cast("long").alias("o_orderkey"), "label", F.col("col").cast("long").alias("col"), "year", "value", "neg", "unit", F.col("scale").cast("int").alias("scale"), "currency", "size")


def q64_evidence_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as figures that cite a calculation over their items, some of which are calculations over suppliers, and those
    over nations, which rest on a supplier again."""
    items, suppliers, nations = (table(spark, sf_dir, n) for n in ("lineitem", "supplier", "nation"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    kind = F.col("l_linenumber") % 4
    source = F.when(kind == 1, name("CS", "l_suppkey")).when(kind == 0, "assumption").otherwise(name("B", "l_partkey"))
    first = suppliers.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("s_suppkey"))
    inputs = (
        items.select(name("CO", "l_orderkey").alias("calc_id"), F.col("l_linenumber").alias("no"), source.alias("source_id"))
        .unionByName(suppliers.select(name("CS", "s_suppkey").alias("calc_id"), F.lit(1).alias("no"), name("CN", "s_nationkey").alias("source_id")))
        .unionByName(suppliers.select(name("CS", "s_suppkey").alias("calc_id"), F.lit(2).alias("no"), name("S", "s_suppkey").alias("source_id")))
        .unionByName(nations.select(name("CN", "n_nationkey").alias("calc_id"), F.lit(1).alias("no"), name("N", "n_nationkey").alias("source_id")))
        .unionByName(first.select(name("CN", "n_nationkey").alias("calc_id"), F.lit(2).alias("no"), name("CS", "s_suppkey").alias("source_id")))
    )
    sources = (
        table(spark, sf_dir, "part").select(name("B", "p_partkey").alias("source_id"), F.col("p_brand").alias("file"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("place"))
        .unionByName(suppliers.select(name("S", "s_suppkey").alias("source_id"), F.lit("Suppliers").alias("file"), F.col("s_name").alias("place")))
        .unionByName(nations.select(name("N", "n_nationkey").alias("source_id"), F.lit("Nations").alias("file"), F.lit(None).cast("string").alias("place")))
    )
    figures = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("figure_id"), name("CO", "o_orderkey").alias("cite"))
    parts = items.rdd.getNumPartitions() * FINER
    return evidence_lines(evidence(figures, inputs, parts=parts), sources, parts).select(F.col("figure_id").alias("o_orderkey"), "line")


#: Formulas over a total (a) and small numbers (b, c), by the order's key.
FORMULAS = ["(a - b) / 4", "a / b", "b ** (0 - c)", "(0 - a) ** 0.5", "a ** 0.5", "a ** (b + 97)", "((a ** 100) ** 100) ** 100", "abs(b - c) * max(a, 4)"]


def q65_exact_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's formula: a result, or the code of what went wrong."""
    k = F.col("o_orderkey")
    number = lambda c: c.cast("decimal(24,6)")
    inputs = F.create_map(F.lit("a"), number(amount("o_totalprice")), F.lit("b"), number(k % 5), F.lit("c"), number(k % 3))
    rows = _dealt_orders(spark, sf_dir).select("o_orderkey", F.get(F.array(*map(F.lit, FORMULAS)), (k % 8).cast("int")).alias("formula"), inputs.alias("inputs"))
    done = rows.select("o_orderkey", exactly(F.col("formula"), F.col("inputs")).alias("r"))
    return done.select("o_orderkey", F.col("r.result").try_cast("decimal(28,6)").alias("result"), "r.used_float", "r.code")


def _dealt_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "orders"))


def q66_store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written in two versions, and a third part that is never committed: ids go on from one to the next."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    path = fresh_folder(spark, "orders")
    for status in ("F", "O"):
        appended(orders.filter(F.col("o_orderstatus") == status), path, [F.col("o_orderkey")])
    written(orders.filter(F.col("o_orderstatus") == "P"), path)
    return with_ids(current(spark, path), "W", "id").select("o_orderkey", "id")


def q67_figures_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as blocks whose figures are the quantities of their items."""
    values = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(" units")).alias("raw"))
    return figures_there(values, "l_suppkey")


def q68_renamed_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas over the names and types of parts, which are no identifiers."""
    formula = F.concat("p_name", F.lit(" / ("), "p_type", F.lit(" - "), "p_name", F.lit(") + rest"))
    text, pairs = renamed(formula, F.array("p_name", "p_type", F.lit("rest")))
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("formula"), F.size(pairs).cast("long").alias("renamed"))


def q69_cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as requests for a page of an order: a third of the pages are cached, and every other order as a whole."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    page = F.when(F.col("l_linenumber") < 6, F.col("l_linenumber"))
    requests = items.select(F.col("l_orderkey").alias("sha"), F.col("l_returnflag").alias("model"), page.alias("pages"))
    pages = items.filter("l_partkey % 3 = 0 and l_linenumber < 6").select(F.col("l_orderkey").alias("sha"), F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("pages"), F.col("l_partkey").alias("result"))
    whole = orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("sha"), F.lit("N").alias("model"), F.lit(None).cast("int").alias("pages"), F.col("o_custkey").alias("result"))
    found = cached(requests, pages.unionByName(whole), ["sha", "model"])
    return found.select(F.col("sha").alias("o_orderkey"), "model", "pages", "level", "result")


_MESSAGES = """m AS (SELECT l_orderkey AS conv_id, l_linenumber AS turn, CASE WHEN l_linenumber % 3 = 1 THEN 'user' WHEN (l_linenumber + l_orderkey) % 2 = 0 THEN 'tool' ELSE 'assistant' END AS role FROM lineitem)"""
_TOTAL = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(24,6))"
_V = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)"

_SLUG = "lower(trim(regexp_replace({}, '[^0-9A-Za-z]+', '_', 'g'), '_'))"
_NAME, _TYPE = _SLUG.format("p_name"), _SLUG.format("p_type")
_A = "CAST(o_totalprice AS DECIMAL(18,2))"
SQL = {
    "q64_evidence_graph": """
WITH RECURSIVE inputs AS (
  SELECT 'CO' || l_orderkey AS calc_id, l_linenumber AS no, CASE l_linenumber % 4 WHEN 1 THEN 'CS' || l_suppkey WHEN 0 THEN 'assumption' ELSE 'B' || l_partkey END AS source_id FROM lineitem
  UNION ALL SELECT 'CS' || s_suppkey, 1, 'CN' || s_nationkey FROM supplier UNION ALL SELECT 'CS' || s_suppkey, 2, 'S' || s_suppkey FROM supplier
  UNION ALL SELECT 'CN' || n_nationkey, 1, 'N' || n_nationkey FROM nation UNION ALL SELECT 'CN' || s_nationkey, 2, 'CS' || min(s_suppkey) FROM supplier GROUP BY s_nationkey),
sources AS (
  SELECT 'B' || p_partkey AS source_id, p_brand AS file, 'size ' || p_size AS place FROM part UNION ALL SELECT 'S' || s_suppkey, 'Suppliers', s_name FROM supplier UNION ALL SELECT 'N' || n_nationkey, 'Nations', NULL FROM nation),
walk AS (
  SELECT o_orderkey, 'CO' || o_orderkey AS node, CAST([] AS INTEGER[]) AS steps, ['CO' || o_orderkey] AS way FROM orders
  UNION ALL SELECT w.o_orderkey, i.source_id, list_append(w.steps, i.no), list_append(w.way, i.source_id) FROM walk w JOIN inputs i ON i.calc_id = w.node WHERE NOT list_contains(w.way, i.source_id)),
leaves AS (SELECT * FROM walk WHERE node NOT IN (SELECT calc_id FROM inputs)),
places AS (SELECT o_orderkey, coalesce(file, node) AS file, place, min(steps) AS steps FROM leaves LEFT JOIN sources ON node = source_id WHERE node <> 'assumption' GROUP BY ALL),
files AS (SELECT o_orderkey, file, min(steps) AS steps, file || coalesce(' · ' || string_agg(place, ', ' ORDER BY steps, place), '') AS line FROM places GROUP BY o_orderkey, file),
lines AS (SELECT o_orderkey, string_agg(line, '; ' ORDER BY steps, line) AS line FROM files GROUP BY o_orderkey),
assumed AS (SELECT o_orderkey, count(*) FILTER (WHERE node = 'assumption') AS n FROM leaves GROUP BY o_orderkey)
SELECT o_orderkey, concat_ws('; ', line, CASE WHEN n = 1 THEN '1 assumption' WHEN n > 1 THEN n || ' assumptions' END) AS line FROM assumed LEFT JOIN lines USING (o_orderkey)""",
    "q65_exact_formulas": f"""
WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS f, {_A} AS a, CAST(o_orderkey % 5 AS INTEGER) AS b, CAST(o_orderkey % 3 AS INTEGER) AS c FROM orders),
r AS (SELECT *, CASE WHEN f = 1 AND b = 0 THEN 'division_by_zero' WHEN f = 2 AND b = 0 THEN 'zero_power' WHEN f = 3 THEN 'negative_base' WHEN f = 5 AND b = 4 THEN 'large_exponent' WHEN f = 6 THEN 'overflow' END AS code FROM o)
SELECT o_orderkey, CASE WHEN code IS NOT NULL THEN NULL WHEN f = 0 THEN CAST((a - b) * CAST(0.25 AS DECIMAL(3,2)) AS DECIMAL(28,6)) WHEN f = 1 THEN CAST(round(CAST(a AS DOUBLE) / b, 6) AS DECIMAL(28,6))
  WHEN f = 2 THEN CAST(round(power(CAST(b AS DOUBLE), -c), 6) AS DECIMAL(28,6)) WHEN f = 4 THEN CAST(round(sqrt(CAST(a AS DOUBLE)), 6) AS DECIMAL(28,6)) WHEN f = 7 THEN CAST(abs(b - c) * greatest(a, 4) AS DECIMAL(28,6)) END AS result,
  f = 4 AS used_float, code FROM r""",
    "q69_cached_pages": """
WITH r AS (SELECT DISTINCT l_orderkey AS o_orderkey, l_returnflag AS model, CASE WHEN l_linenumber < 6 THEN l_linenumber END AS pages FROM lineitem),
p AS (SELECT l_orderkey AS k, l_returnflag AS m, l_linenumber AS n, min(l_partkey) AS result FROM lineitem WHERE l_partkey % 3 = 0 AND l_linenumber < 6 GROUP BY ALL)
SELECT r.o_orderkey, model, pages, CASE WHEN p.result IS NOT NULL THEN 'pages' WHEN o.o_custkey IS NOT NULL THEN 'file' END AS level, coalesce(p.result, o.o_custkey) AS result
FROM r LEFT JOIN p ON p.k = r.o_orderkey AND p.m = r.model AND p.n = r.pages LEFT JOIN orders o ON o.o_orderkey = r.o_orderkey AND o.o_orderkey % 2 = 0 AND r.model = 'N'""",
    "q67_figures_there": "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' units'))[1:15], ', ') AS figures FROM lineitem GROUP BY l_suppkey",
    "q68_renamed_formulas": f"""WITH p AS (SELECT p_partkey, p_name, p_type, NOT regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_]*$') AS n, NOT regexp_matches(p_type, '^[A-Za-z_][A-Za-z0-9_]*$') AS t FROM part)
 SELECT p_partkey, CASE WHEN n THEN {_NAME} ELSE p_name END || ' / (' || CASE WHEN t THEN {_TYPE} ELSE p_type END || ' - ' || CASE WHEN n THEN {_NAME} ELSE p_name END || ') + rest' AS formula, CAST(n AS BIGINT) + CAST(t AS BIGINT) AS renamed FROM p""",
    "q66_store_versions": "SELECT o_orderkey, 'W' || row_number() OVER (ORDER BY o_orderstatus, o_orderkey) AS id FROM orders WHERE o_orderstatus IN ('F', 'O')",
    "q56_ways_to_write": f"""WITH o AS (SELECT o_orderkey, {_V} AS v, CASE o_orderkey % 3 WHEN 0 THEN '$' WHEN 1 THEN 'CHF ' ELSE '' END AS pre, o_orderkey % 4 AS s, CASE o_orderkey % 3 WHEN 0 THEN '$' WHEN 1 THEN 'CHF' END AS sym FROM orders)
 SELECT o_orderkey, pre || format('{{:,.2f}}', v) || (['', 'k', 'm', 'bn'])[s + 1] || CASE WHEN v < 1000 THEN '' ELSE ' or ' || pre || CASE WHEN v >= 100000 THEN format('{{:,.0f}}', round(v / 1000, 0)) WHEN v >= 10000 THEN format('{{:,.1f}}', round(v / 1000, 1))
   ELSE format('{{:,.2f}}', round(v / 1000, 2)) END || (['k', 'm', 'bn', 'tn'])[s + 1] END AS ways,
  CASE WHEN o_orderkey % 5 = 0 THEN 'pence' WHEN s = 0 THEN coalesce(sym, 'units') WHEN sym IS NULL THEN (['thousands', 'millions', 'billions'])[s] ELSE sym || ' ' || (['thousand', 'million', 'billion'])[s] END AS stated FROM o""",
    "q57_read_requests": """SELECT p_partkey, CASE p_partkey % 7 WHEN 1 THEN 'relative_path' WHEN 2 THEN 'no_document' WHEN 6 THEN 'no_document' WHEN 3 THEN 'too_many_pages' WHEN 4 THEN 'out_of_range'
   WHEN 5 THEN CASE WHEN p_size < 2 THEN 'out_of_range' END ELSE CASE WHEN p_size > 30 THEN 'too_many_pages' END END AS problem FROM part""",
    "q58_pages_to_read": """SELECT o_orderkey AS doc_id, page FROM orders, (SELECT unnest(range(1, 8)) AS page) WHERE (o_orderkey % 2 = 1 OR page IN (1, 7)) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = page)""",
    "q59_question_ids": "SELECT conv_id, turn, substr(sha256(CAST(conv_id AS VARCHAR) || chr(10) || turn || chr(10) || coalesce(text, '')), 1, 12) AS question FROM conversations WHERE role = 'user'",
    "q60_valid_calculations": f"WITH {_MESSAGES} SELECT DISTINCT t.conv_id, 'C' || t.turn AS calc_id FROM m t JOIN m u ON t.conv_id = u.conv_id AND u.turn = 1 WHERE t.role = 'tool'",
    "q61_drafts": f"""WITH {_MESSAGES}, d AS (SELECT conv_id, turn, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS since FROM m WHERE role = 'user' AND turn > 1)
 SELECT d.conv_id, CAST(d.turn AS BIGINT) AS turn, (SELECT 'text ' || max(a.turn) FROM m a WHERE a.conv_id = d.conv_id AND a.role = 'assistant' AND a.turn > d.since AND a.turn < d.turn) AS draft FROM d""",
    "q62_denials": "SELECT user_id AS question, count(*) AS checks, count(*) FILTER (WHERE event_type = 'purchase') AS denials FROM events GROUP BY user_id",
    "q63_block_values": f"""WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, {_TOTAL} AS p, CAST(o_orderkey % 100 + 1.5 AS DECIMAL(24,6)) AS c FROM orders)
 SELECT o_orderkey, 'Total' AS label, 1 AS col, y AS year, p AS value, false AS neg, NULL AS unit, 6 AS scale, 'GBP' AS currency, p * 1000000 AS size FROM o
 UNION ALL SELECT o_orderkey, 'Total', 2, y - 1, p, true, NULL, 6, 'GBP', p * 1000000 FROM o
 UNION ALL SELECT o_orderkey, 'Per share', 1, y, c, false, 'p', 0, NULL, c FROM o UNION ALL SELECT o_orderkey, 'Per share', 2, y - 1, 7, false, 'p', 0, NULL, 7 FROM o""",
}

QUERIES = {f.__name__: f for f in (q64_evidence_graph, q65_exact_formulas, q66_store_versions, q67_figures_there, q68_renamed_formulas, q69_cached_pages, q56_ways_to_write, q57_read_requests, q58_pages_to_read, q59_question_ids, q60_valid_calculations, q61_drafts, q62_denials, q63_block_values)}
