"""OCR responses, conversations and transcripts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from numerant.functions.text import normalised

BLOCK = "struct<top_left_x int, top_left_y int, bottom_right_x int, bottom_right_y int, content string, type string>"
RESPONSE = f"doc_id string, model string, pages array<struct<index int, dimensions struct<dpi int, height int, width int>, blocks array<{BLOCK}>>>"

SNIPPET = "struct<title string, url string, description string, snippets array<string>>"
CARD = "struct<title string, series array<struct<points array<struct<x string, y double>>>>>"
CONVERSATION = "conv_id string, outputs array<struct<type string, content array<struct<type string, text string, title string, url string, description string>>, result array<struct<text string>>>>"


def ocr_responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored responses, one JSON document per file."""
    return spark.read.schema(RESPONSE).option("multiLine", True).json(path)


def ocr_blocks(responses: DataFrame) -> DataFrame:
    """One row per block: block_id (document, page from 1, number from 1 over all blocks of the page), doc_id, page_index,
    n, type, bbox, raw_text, text, and the page's width and height. Documents or pages without blocks have no row."""
    pages = responses.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.index", "p.dimensions", F.posexplode("p.blocks").alias("pos", "b"))
    n = F.col("pos") + 1
    return pages.select(
        F.concat(F.col("doc_id"), F.lit(":p"), F.col("index") + 1, F.lit(":b"), n).alias("block_id"), "doc_id", F.col("index").alias("page_index"), n.alias("n"), F.col("b.type").alias("type"),
        F.array("b.top_left_x", "b.top_left_y", "b.bottom_right_x", "b.bottom_right_y").alias("bbox"), F.col("b.content").alias("raw_text"), normalised(F.coalesce("b.content", F.lit(""))).alias("text"),
        F.col("dimensions.width").alias("width"), F.col("dimensions.height").alias("height"),
    )


def citable(block_type: Column) -> Column:
    return ~block_type.isin("header", "footer", "title")


def listing(blocks: DataFrame) -> DataFrame:
    """block_id and line: each line of each block as it is shown to a reader; headings are marked, running heads left out."""
    shown = blocks.filter(~F.col("type").isin("header", "footer"))
    lines = shown.select("block_id", "type", F.posexplode(F.split("text", "\n")).alias("line_no", "t")).filter(F.trim("t") != "")
    mark = F.when(F.col("type") == "title", F.lit("(heading) ")).otherwise(F.concat(F.lit("["), F.col("block_id"), F.lit("] ")))
    return lines.select("block_id", "line_no", F.concat(mark, "t").alias("line"))


def plain(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", "")


def conversation_sources(conversations: DataFrame) -> DataFrame:
    """conv_id, url (or title of a data card), title, description, snippets: what the tools of a conversation returned.

    Results are JSON texts: per source an object with a url, or a data card with series, whose points become one
    snippet. The first mention of a url counts, so references in answers only add what the results lack.
    """
    parts = conversations.select("conv_id", F.posexplode("outputs").alias("o", "e"))
    results = parts.filter("e.type = 'tool.execution'").select("conv_id", "o", F.posexplode("e.result").alias("r", "t")).withColumn("json", F.col("t.text"))
    sources = results.select("conv_id", "o", "r", F.explode(F.from_json("json", f"map<string, {SNIPPET}>")).alias("k", "s")).filter("s.url is not null")
    found = sources.select("conv_id", F.array("o", "r").alias("at"), F.col("s.url").alias("key"), F.col("s.title").alias("title"), plain(F.col("s.description")).alias("description"), F.transform(F.coalesce("s.snippets", F.array()), lambda x: plain(x)).alias("snippets"))
    card = F.from_json("json", f"struct<description string, content struct<card_data {CARD}>>")
    cards = results.withColumn("c", card).filter("c.content is not null and c.description is not null")
    points = F.flatten(F.transform("c.content.card_data.series", lambda s: F.transform(F.filter(s["points"], lambda p: p["y"].isNotNull()), lambda p: F.concat(F.coalesce(p["x"], F.lit("?")), F.lit(": "), F.format_number(F.bround(p["y"], 0), 0)))))
    series = F.array_join(F.coalesce(points, F.array()), "; ")
    title = F.coalesce("c.content.card_data.title", F.lit("Data card"))
    carded = cards.select("conv_id", F.array("o", "r").alias("at"), F.concat(F.lit("card:"), title).alias("key"), title.alias("title"), plain(F.col("c.description")).alias("description"), F.filter(F.array(plain(F.col("c.description")), series), lambda x: x != "").alias("snippets"))
    told = parts.filter("e.type = 'message.output'").select("conv_id", "o", F.posexplode("e.content").alias("r", "c")).filter("c.type = 'tool_reference' and c.url is not null")
    told = told.select("conv_id", F.array("o", "r").alias("at"), F.col("c.url").alias("key"), F.col("c.title").alias("title"), plain(F.col("c.description")).alias("description"), F.array().cast("array<string>").alias("snippets"))
    every = found.unionByName(carded).unionByName(told)
    return every.groupBy("conv_id", "key").agg(F.min_by(F.struct("title", "description", "snippets"), "at").alias("s")).select("conv_id", "key", "s.*")


def conversation_answers(conversations: DataFrame) -> DataFrame:
    """conv_id and answer: the text parts of all outputs, in order."""
    said = F.filter("outputs", lambda e: e["type"] == "message.output")
    texts = F.transform(said, lambda e: F.transform(F.filter(e["content"], lambda c: c["type"] == "text"), lambda c: F.coalesce(c["text"], F.lit(""))))
    return conversations.select("conv_id", F.array_join(F.flatten(texts), "").alias("answer"))
