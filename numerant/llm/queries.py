"""The driver's queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from numerant.llm import debruijn, decontamination, language, merkle, packing, partenum, periodic, quality, secret_scan, token_files, tokens, toxicity, url_rules, voronoi
from numerant.llm.common import ASCII_UPPER, fold, fresh_path, read

END_ID = 2

#: The rules of the URL filter (action, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def in_fold(modulus: int, rest: int) -> Column:
    return F.coalesce(fold(F.col("doc_id"), modulus) == rest, F.lit(False))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~in_fold(4, 2)))
    return language.identify(docs, model).select("doc_id", in_fold(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op4_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.inner_product_top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(read(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), tokens.vocabulary("word_bpe_49k.json"), END_ID)
    return token_files.read_tokens(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~in_fold(5, 0)), label="toxic")
    return toxicity.score_documents(docs, model).select("doc_id", in_fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"), END_ID)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_groups(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~in_fold(3, 1)), label="quality")
    return quality.score_documents(docs, model).select("doc_id", in_fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_rules.host_rule(*r) for r in URL_RULES]
    judged = url_rules.judge_urls(read(spark, sf_dir, "pages"), rules + url_rules.junk_globs())
    by_rule = F.col("rule").isin([r.name for r in rules])
    return judged.select("page_id", "host", "path", F.when(by_rule, F.col("rule")).alias("rule"), "verdict", F.when(~by_rule, F.col("rule")).alias("pattern"))


_JUNK = "\n    ".join(f"WHEN contains(host, '{w}') THEN '*{w}*/**'" for w in url_rules.JUNK_WORDS)
OP10_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, regexp_extract(r, '\A[^/?#]*') AS raw, r FROM rest),
urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(raw) + 1), '\A[^?#]*') AS path FROM parts),
ruled AS (
  SELECT *, '.' || host AS h,
    CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM urls),
globbed AS (
  SELECT *, CASE WHEN rule IS NOT NULL OR NOT starts_with(path, '/') THEN NULL
    {JUNK} END AS pattern FROM ruled)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM globbed
""".replace("{JUNK}", _JUNK)


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, changed as the contract says where crc32(doc_id) ends in 0: from word a on, the words repeat."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    n, g = F.size(words), F.expr("_h div 10")
    a = (g % n).cast("int")
    period = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, period), F.ceil((n - a) / period).cast("int")))
    turned = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return rows.select("doc_id", F.when((F.col("_h") % 10 == 0) & (n > 0), turned).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted_periods(read(spark, sf_dir, "documents")))
    ranked = F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("e"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", F.array_min(ranked)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The unsigned CRC-32 of a document's id in decimal, in SQL: eight shifts for each of its bytes.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""

# A run of t equal places at lag q holds t - 7 equal stretches of eight words in a row.
OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '') AS o, CAST({CRC} AS BIGINT) AS h FROM documents),
a AS (SELECT doc_id, o, len(o) AS n, h, h // 10 AS g, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) ELSE o END AS w FROM p),
grams AS (SELECT doc_id, n, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5], w[i + 6], w[i + 7], w[i + 8]) AS gram FROM (SELECT *, unnest(range(n - 7)) AS i FROM w WHERE n >= 24)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + 7 + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + 7 + q >= greatest(24, 3 * q)),
runs AS (
  SELECT s.doc_id, s.start, s.length, s.q FROM stretch s WHERE NOT EXISTS (
    SELECT 1 FROM stretch t WHERE t.doc_id = s.doc_id AND t.q < s.q AND s.q % t.q = 0 AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / q DESC, start, q) AS k FROM runs) WHERE k = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM w) u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.q AS period, 1000 * b.length // b.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM w LEFT JOIN listed l USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept k USING (doc_id)
""".replace("{CRC}", _CRC_SQL)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = ASCII_UPPER
    lowered = F.translate("text", upper, upper.lower())
    tampered = F.coalesce(fold(F.col("doc_id"), 3) == 0, F.lit(False))
    return merkle.manifest(read(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", now={"text": F.when(tampered, lowered).otherwise(F.col("text"))})


def _tree_sql(name: str, below: str, levels: int) -> str:
    """Tables of a tree over ``below`` (g, i, h): name_0 to name_levels, the nodes of each level with what stands left and
    right of them in their run (l, r; a lone node of a level stays as it is)."""
    out = [f"{name}_n0 AS ({below})"]
    for k in range(levels):
        out.append(
            f"{name}_{k} AS (SELECT a.g, a.i, any_value(a.h) AS h, any_value(a.c) AS c, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, "
            f"coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}_n{k}) a "
            f"JOIN {name}_n{k} b ON a.g = b.g AND a.i // 8 = b.i // 8 GROUP BY a.g, a.i)"
        )
        out.append(f"{name}_n{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN max(c) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}_{k} GROUP BY g, i // 8)")
    return ",\n".join(out)


def _folded_sql(source: str, name: str, levels: int, g: str, i: str) -> str:
    """Steps (fold_name_k) that carry x up the tree, level by level, and gather the siblings in p."""
    out = []
    for k in range(levels):
        out.append(
            f"fold_{name}_{k} AS (SELECT f.* REPLACE (CASE WHEN t.c = 1 THEN f.x ELSE sha256(t.l || f.x || t.r) END AS x, f.p || t.l || t.r AS p) "
            f"FROM {source} f JOIN {name}_{k} t ON t.g = f.{g} AND t.i = f.{i} // {8**k})"
        )
        source = f"fold_{name}_{k}"
    return ",\n".join(out)


_FIELDS = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {{{c}}} END" for c in ("doc_id", "source", "lang", "n_chars", "text"))
_FIELDS = _FIELDS.replace("{doc_id}", "doc_id").replace("{source}", "source").replace("{lang}", "lang").replace("{n_chars}", "n_chars")
_LEVELS, _ROOT_LEVELS = 9, 3  # up to 8 ** 9 documents of a language and 512 languages
OP12_SQL = f"""
WITH d AS (SELECT *, coalesce('=' || lang, '-') AS g, coalesce({_CRC_SQL} % 3 = 0, false) AS tampered FROM documents),
leaves AS (
  SELECT doc_id, g, sha256({_FIELDS.replace("{text}", "text")}) AS leaf,
    sha256({_FIELDS.replace("{text}", f"CASE WHEN tampered THEN translate(text, '{ASCII_UPPER}', '{ASCII_UPPER.lower()}') ELSE text END")}) AS present FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
{_tree_sql("t", "SELECT g, i, leaf AS h FROM placed", _LEVELS)},
subroots AS (SELECT g AS lang_g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS k FROM t_n{_LEVELS}),
{_tree_sql("u", "SELECT 0 AS g, k AS i, subroot AS h FROM subroots", _ROOT_LEVELS)},
start AS (SELECT p.doc_id, p.g, p.i, p.leaf, p.present AS x, '' AS p, s.subroot, s.k, 0 AS zero FROM placed p JOIN subroots s ON s.lang_g = p.g),
{_folded_sql("start", "t", _LEVELS, "g", "i")},
{_folded_sql(f"fold_t_{_LEVELS - 1}", "u", _ROOT_LEVELS, "zero", "k")}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(p) AS proof_sha256, x AS folded_root, x = r.h AS verified
FROM fold_u_{_ROOT_LEVELS - 1}, (SELECT h FROM u_n{_ROOT_LEVELS}) r
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.without_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 20], ' ')) AS x FROM (SELECT *, unnest(range(len(w) - 19)) AS i FROM w WHERE len(w) >= 20)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM ranked WHERE k > 1),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict:
    named = (op1_secret_scan, op2_decontamination, op3_language_id, op4_voronoi_top_k, op5_token_files, op6_toxicity, op7_best_fit_packing, op8_ngram_jaccard, op9_quality, op10_url_rules, op11_periodic_runs, op12_merkle_manifest, op13_substring_dedup)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op4_voronoi_top_k": OP4_SQL, "op10_url_rules": OP10_SQL, "op11_periodic_runs": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_substring_dedup": OP13_SQL}
