"""Transcripts and requests as they come in: JSON lines of a session, and the request that names it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Why an answer is not checked.
NO_QUESTION, NO_ANSWER = "no question found in the transcript", "no answer in this turn"
BAD_INPUT, BAD_TRANSCRIPT, NO_TRANSCRIPT = "the hook input was not valid JSON", "the transcript could not be read", "no transcript file"


def message_text(content: Column) -> Column:
    """The text of a message's content, given as JSON: a string, an object with a text, or a list of these, whose texts
    come one to a line; null is empty."""

    def of(part: Column) -> Column:
        inner = F.get_json_object(part, "$.text")
        return F.when(part.startswith('"'), F.from_json(F.concat(F.lit('{"t":'), part, F.lit("}")), "t string")["t"]).when(part.startswith("{"), F.coalesce(inner, F.lit(""))).otherwise("")

    parts = F.transform(F.from_json(F.concat(F.lit('{"p":'), content, F.lit("}")), "p array<string>", {"primitivesAsString": "true"})["p"], lambda p: p)
    listed = F.array_join(F.filter(F.transform(parts, lambda p: F.when(p.startswith("{"), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p)), lambda t: t != ""), "\n")
    return F.coalesce(F.when(content.startswith("["), listed).otherwise(of(content)), F.lit(""))


def transcripts(lines: DataFrame, session: str = "session", pos: str = "pos", line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(messages, broken) of JSON lines: messages have session, pos, role, text and injected; ``broken`` the sessions
    with a line that is no JSON, of which nothing can be checked. Blank lines, and values other than objects, are passed
    over."""
    rows = lines.filter(F.trim(F.coalesce(line, F.lit(""))) != "").withColumn("_json", F.expr(f"try_parse_json(`{line}`)"))
    broken = rows.filter("_json is null").select(session).distinct()
    sound = rows.filter("_json is not null").join(broken, session, "left_anti").filter(F.expr("schema_of_variant(_json)").startswith("OBJECT"))
    field = lambda name, kind="string": F.try_variant_get("_json", f"$.{name}", kind)
    content = F.to_json(F.try_variant_get("_json", "$.content", "variant"))
    return sound.select(session, pos, field("role").alias("role"), message_text(content).alias("text"), F.coalesce(field("injected", "boolean"), F.lit(False)).alias("injected")), broken


def requests(rows: DataFrame, request: str = "request") -> DataFrame:
    """``rows`` with cwd, session, transcript and problem of requests given as JSON text: what is no JSON object, or names
    no transcript, says so."""
    parsed = F.expr(f"try_parse_json(`{request}`)")
    field = lambda name: F.try_variant_get(parsed, f"$.{name}", "string")
    sound = F.coalesce(F.expr(f"schema_of_variant(try_parse_json(`{request}`))").startswith("OBJECT"), F.lit(False))
    path = field("transcript_path")
    problem = F.when(~sound, BAD_INPUT).when(path.isNull() | (path == ""), NO_TRANSCRIPT)
    return rows.withColumns({"cwd": F.when(sound, field("cwd")), "session": F.when(sound, field("session_id")), "transcript": F.when(sound, path), "problem": problem})


def runs_with_sessions(runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each run (dir) with the newest session whose working directory it is: sessions have cwd, started and session."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, "/+", "/"), "(?<=.)/$", "")
    newest = sessions.filter("cwd is not null").groupBy(clean(F.col("cwd")).alias("_cwd")).agg(F.max_by("session", "started").alias("session"))
    return runs.withColumn("_cwd", clean(F.col("dir"))).join(newest, "_cwd", "left").drop("_cwd")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of transcript files: session (the file's name), pos and line."""
    text = spark.read.option("wholetext", False).text(path).withColumn("session", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1))
    return text.withColumn("pos", F.monotonically_increasing_id()).withColumnRenamed("value", "line")
