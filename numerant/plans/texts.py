"""Queries over texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numerant.functions import text as T
from numerant.lexicon import BLOCK_TAGS, LOOSE_NUMBER, NUMBER, SKIPPED_TAGS, STOP_WORDS, WORD
from numerant.operators.retrieval import lines_of, page_holding, top_passages, verified_quotes
from numerant.sources.tables import table


def q01_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.normalised(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest"))


def q02_number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", T.number_tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return found.select("doc_id", F.size("t").cast("long").alias("n"), F.element_at("t", 1).alias("first"), F.element_at("t", -1).alias("last"))


def q03_number_values_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that aren't long references, by language."""
    each = table(spark, sf_dir, "documents").select("lang", F.explode(T.number_tokens(F.col("text"))).alias("t"))
    plain = F.replace("t", F.lit(","), F.lit(""))
    kept = each.filter((F.length(plain) < 8) | F.col("t").contains(",") | F.col("t").contains(".")).withColumn("v", plain.try_cast("decimal(24,6)"))
    return kept.groupBy("lang").agg(F.count("v").alias("n"), F.sum("v").cast("decimal(34,6)").alias("total"), F.max("v").alias("most"))


def q04_page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "pages").select("page_id", T.html_paragraphs(F.col("html")).alias("p"))
    return parts.select("page_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "\n")).alias("digest"))


def q05_url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.domain(F.col("url")).alias("domain"), T.safe_url(F.col("url")).isNotNull().alias("safe"))


def q06_passages_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(table(spark, sf_dir, "documents"), "doc_id")
    return top_passages(table(spark, sf_dir, "benchmark"), lines, "item_id", "doc_id")


def q07_quote_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of(table(spark, sf_dir, "documents"), "doc_id")
    return verified_quotes(table(spark, sf_dir, "benchmark").select("item_id", "text"), lines, "item_id", "doc_id")


def q08_passage_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that holds most lines of each benchmark item, if it is the only one."""
    rows = lines_of(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", T.squashed(F.col("text")).alias("row")).filter(F.length("row") > 20).distinct()
    pages = lines_of(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", T.squashed(F.col("text")).alias("row")).distinct()
    return page_holding(rows.join(pages, "row"), "item_id", "doc_id")


_NORMALISED = r"""regexp_replace(translate(replace(replace(replace(replace(regexp_replace(replace(regexp_replace(regexp_replace(
  replace(text, '**', ''), '\$\s*\{\s*\}\s*\^\{[^}]*\}\s*\$', '', 'g'), '\^\{[^}]*\}', '', 'g'), '\$', '$'),
  '\$([^$\n]*\\[^$\n]*)\$', '\1', 'g'), '\%', '%'), '\times', 'x'), 'm³', 'm3'), 'm²', 'm2'),
  chr(160) || chr(8201) || chr(8239) || chr(8199) || chr(8722) || '¹²³⁴⁵⁶⁷⁸⁹⁰', '    -'), '[ \t]+', ' ', 'g')"""
_FLAT = "trim(regexp_replace(lower(replace(replace({0}, '**', ' '), '|', ' ')), '\\s+', ' ', 'g'))"
_WORDS = "list_distinct(regexp_extract_all(" + _FLAT + f", '{WORD.replace(chr(39), chr(39) * 2)}'))"
_LINES = "SELECT {key}, unnest(generate_series(0, len(l) - 1)) AS line, unnest(l) AS text FROM (SELECT {key}, string_split(text, chr(10)) AS l FROM {table})"


def _paragraphs() -> str:
    t = "coalesce(html, '')"
    for tag in [*SKIPPED_TAGS, "title"]:
        t = rf"regexp_replace({t}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '\s+', ' ', 'g'), '(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{name}', '{char}')"
    return rf"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) > 20)"


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"

SQL = {
    "q01_normalise": f"SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, {_NORMALISED} AS t FROM documents)",
    "q02_number_tokens": rf"SELECT doc_id, len(t) AS n, t[1] AS first, t[-1] AS last FROM (SELECT doc_id, regexp_extract_all(text, '{NUMBER}') AS t FROM documents) WHERE len(t) > 0",
    "q03_number_values_by_lang": rf"""
WITH e AS (SELECT lang, unnest(regexp_extract_all(text, '{NUMBER}')) AS t FROM documents),
k AS (SELECT lang, TRY_CAST(replace(t, ',', '') AS DECIMAL(24,6)) AS v FROM e WHERE length(replace(t, ',', '')) < 8 OR contains(t, ',') OR contains(t, '.'))
SELECT lang, count(v) AS n, CAST(sum(v) AS DECIMAL(34,6)) AS total, max(v) AS most FROM k GROUP BY lang""",
    "q04_page_paragraphs": f"SELECT page_id, len(p) AS n, md5(array_to_string(p, chr(10))) AS digest FROM (SELECT page_id, {_paragraphs()} AS p FROM pages)",
    "q05_url_domain": r"""SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '') AS domain,
 CASE WHEN url IS NOT NULL AND regexp_matches(url, '(?i)^https?://') THEN true ELSE false END AS safe FROM pages""",
    "q06_passages_topk": rf"""
WITH l AS ({_LINES.format(key="doc_id", table="documents")}),
w AS (SELECT doc_id, CAST(line AS INTEGER) AS line, unnest(list_filter({_WORDS.format("text")}, lambda x: NOT list_contains({_STOP}, x))) AS word FROM l WHERE regexp_matches(text, '{LOOSE_NUMBER}')),
q AS (SELECT item_id, unnest(list_filter({_WORDS.format("text")}, lambda x: NOT list_contains({_STOP}, x))) AS word FROM benchmark),
s AS (SELECT item_id, doc_id, line, 3 * count(*) AS score FROM w JOIN q USING (word) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, line) AS INTEGER) AS rank FROM s)
SELECT * FROM r WHERE rank <= 6""",
    "q07_quote_verify": rf"""
WITH l AS ({_LINES.format(key="doc_id", table="documents")}),
t AS (SELECT doc_id, CAST(line AS INTEGER) AS line, {_WORDS.format("text")} AS words, list_transform(regexp_extract_all(text, '{LOOSE_NUMBER}'), lambda x: replace(x, ',', '')) AS numbers FROM l),
q AS (SELECT item_id, {_WORDS.format("text")} AS asked, list_transform(regexp_extract_all(text, '{LOOSE_NUMBER}'), lambda x: replace(x, ',', '')) AS wanted FROM benchmark),
s AS (SELECT item_id, doc_id, line, len(list_intersect(asked, words)) / len(asked) AS score FROM q, t WHERE len(asked) > 0 AND list_has_all(numbers, wanted)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, line) AS r FROM s WHERE score >= 0.6)
SELECT item_id, doc_id, line, round(score, 6) AS score FROM r WHERE r = 1""",
    "q08_passage_page": rf"""
WITH b AS (SELECT DISTINCT item_id, trim(lower(regexp_replace(text, '[\s*]+', ' ', 'g'))) AS row FROM ({_LINES.format(key="item_id", table="benchmark")})),
d AS (SELECT DISTINCT doc_id, trim(lower(regexp_replace(text, '[\s*]+', ' ', 'g'))) AS row FROM ({_LINES.format(key="doc_id", table="documents")})),
c AS (SELECT item_id, doc_id, count(*) AS n FROM b JOIN d USING (row) WHERE length(row) > 20 GROUP BY ALL),
m AS (SELECT *, max(n) OVER (PARTITION BY item_id) AS most FROM c)
SELECT item_id, CASE WHEN count(*) = 1 THEN max(doc_id) END AS doc_id, max(n) AS n_rows FROM m WHERE n = most GROUP BY item_id""",
}

QUERIES = {f.__name__: f for f in (q01_normalise, q02_number_tokens, q03_number_values_by_lang, q04_page_paragraphs, q05_url_domain, q06_passages_topk, q07_quote_verify, q08_passage_page)}
