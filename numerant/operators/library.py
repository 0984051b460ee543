"""Passages that may be cited: from chunks and documents of a library, from web pages, and from answers with quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from numerant.functions.text import flattened, html_paragraphs, is_separator_row, normalised, printed_page, row_cells, squashed, word_set
from numerant.lexicon import BARE_PAGE, LOOSE_NUMBER, STOP_WORDS, UNIT_LINE
from numerant.operators.blocks import unit_of_cell
from numerant.operators.citations import expanded, quote_ids
from numerant.operators.retrieval import page_holding

CHUNKS = 2


def chunk_page(text: Column) -> Column:
    """The printed page of a chunk: of a running head, or of a line with a number alone, among its first five lines."""
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != ""), 1, 5)
    pages = F.filter(F.transform(lines, lambda x: F.coalesce(printed_page(x), F.when(x.rlike(BARE_PAGE), F.regexp_extract(x, BARE_PAGE, 1).cast("int")))), lambda p: p.isNotNull())
    return F.try_element_at(pages, F.lit(1))


def _terms(words: Column) -> Column:
    return F.array_except(words, F.array(*map(F.lit, STOP_WORDS)))


def best_lines(questions: DataFrame, lines: DataFrame, key: str, within: list[str], k: int = 6) -> DataFrame:
    """Of each document of a question (both in ``within``, which ``key`` is one of), the k lines with a number that say
    most of the question's words, three points each, and of its answer's words, one each; if no line does, the first k
    lines with a number. Lines that are there twice count once; what is kept comes in the document's order.

    ``questions``: key, text and optionally answer; ``lines``: within, line, text. Blank questions keep the first lines.
    """
    answer = F.col("answer") if "answer" in questions.columns else F.lit("")
    asked = questions.select(key, _terms(word_set(F.coalesce("text", F.lit("")))).alias("_asked"), _terms(word_set(F.coalesce(answer, F.lit("")))).alias("_told"))
    numbered = lines.filter(F.col("text").rlike(LOOSE_NUMBER)).withColumn("_words", word_set(F.col("text")))
    once = numbered.withColumn("_nth", F.row_number().over(Window.partitionBy(*within, flattened(F.col("text"))).orderBy("line"))).filter("_nth = 1").join(asked, key)
    score = F.size(F.array_intersect("_words", "_asked")) * 3 + F.size(F.array_intersect("_words", "_told"))
    scored = once.withColumn("score", score)
    place = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("score"), "line"))
    kept = scored.withColumn("_r", place).withColumn("_any", F.max("score").over(Window.partitionBy(*within))).filter((F.col("_r") <= k) & ((F.col("score") > 0) | (F.col("_any") == 0)))
    return kept.select(*within, "line", "text", "score")


def best_chunks(chunks: DataFrame, questions: DataFrame, key: str, doc: str, k: int = CHUNKS) -> DataFrame:
    """The k chunks (key, doc, chunk, text) of a document that share most words with the question; ties go to the later."""
    asked = questions.select(key, _terms(word_set(F.coalesce("text", F.lit("")))).alias("_asked"))
    shared = F.size(F.array_intersect(word_set(F.col("text")), "_asked"))
    ranked = chunks.join(asked, key).withColumn("_r", F.row_number().over(Window.partitionBy(key, doc).orderBy(F.desc(shared), F.desc("chunk"))))
    return ranked.filter(F.col("_r") <= k).drop("_r", "_asked")


ANCHOR = 6  # characters by which names that hold each other meet


def _anchors(text: Column) -> Column:
    """All stretches of a text of up to ``ANCHOR`` characters."""
    n = F.length(text)
    of_size = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, k))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(ANCHOR))), of_size)))


def _held(short: DataFrame, long: DataFrame, inner: str, outer: str) -> DataFrame:
    """Pairs of rows where the text ``inner`` of ``short`` stands in ``outer`` of ``long``: they meet by the first characters of
    the shorter one, and are then compared."""
    probes = short.filter(F.length(inner) > 0).withColumn("_gram", F.substring(inner, 1, ANCHOR))
    places = long.filter(F.length(outer) > 0).withColumn("_gram", F.explode(_anchors(F.col(outer))))
    return probes.join(places, "_gram").filter(F.col(outer).contains(F.col(inner))).select("ref_id", "doc_id", "name", "pos")


def matched_documents(references: DataFrame, documents: DataFrame) -> DataFrame:
    """Each reference (ref_id, title) with the first document (doc_id, pos, name) that it names: the same name, or one that
    holds the other. Names without a letter of case differ in nothing; an empty title names the first document, and an
    empty name is named by all. References without a document are left out."""
    refs = references.select("ref_id", F.lower(F.coalesce("title", F.lit(""))).alias("_title"))
    docs = documents.select("doc_id", "pos", "name", F.lower(F.coalesce("name", F.lit(""))).alias("_name"))
    one = lambda rows: rows.agg(F.min_by(F.struct("doc_id", "name", "pos"), "pos").alias("d")).filter("d is not null").select("d.*")
    always = refs.crossJoin(F.broadcast(one(docs.filter("_name = ''")))).select("ref_id", "doc_id", "name", "pos")  # one row
    untitled = refs.filter("_title = ''").crossJoin(F.broadcast(one(docs))).select("ref_id", "doc_id", "name", "pos")  # one row
    pairs = _held(docs, refs, "_name", "_title").union(_held(refs, docs, "_title", "_name")).union(always).union(untitled)
    return pairs.groupBy("ref_id").agg(F.min_by(F.struct("doc_id", "name"), "pos").alias("d")).select("ref_id", "d.*")


def with_place(lines: DataFrame, within: list[str]) -> DataFrame:
    """Lines of documents with page (of the nearest running head at or above), unit (the nearest line above that states
    a unit, or this one), is_head, table (its number, null outside tables) and header (of the table: its lines down to
    the separator)."""
    order = Window.partitionBy(*within).orderBy("line")
    rows = lines.withColumn("_page", printed_page(F.col("text"))).withColumn("is_head", F.col("_page").isNotNull())
    rows = rows.withColumn("page", F.last("_page", ignorenulls=True).over(order)).withColumn("unit", F.last(F.when(F.col("text").rlike(UNIT_LINE), F.col("text")), ignorenulls=True).over(order))
    inside = F.ltrim("text").startswith("|")
    starts = inside & ~F.coalesce(F.lag(inside).over(order), F.lit(False))
    rows = rows.withColumn("table", F.when(inside, F.sum(starts.cast("int")).over(order)))
    of_table = Window.partitionBy(*within, "table")
    sep = F.min(F.when(F.col("table").isNotNull() & is_separator_row(F.col("text")), F.col("line"))).over(of_table)
    rows = rows.withColumn("_sep", F.when(F.col("table").isNotNull(), sep))
    heads = F.array_sort(F.collect_list(F.when(F.col("line") <= F.col("_sep"), F.struct("line", "text"))).over(of_table))
    return rows.withColumn("header", F.when(F.col("_sep").isNotNull(), F.transform(heads, lambda x: x["text"]))).drop("_page", "_sep")


def unit_rows(lines: DataFrame, within: list[str]) -> DataFrame:
    """Lines of tables with unit_row: the nearest row above, below the header, whose cells are units."""
    cells = F.filter(F.slice(row_cells(F.col("text")), 2, 1000), lambda c: c != "")
    units = F.ltrim("text").startswith("|") & (F.size(cells) > 0) & F.forall(cells, lambda c: unit_of_cell(c).isNotNull())
    ahead = Window.partitionBy(*within).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("unit_row", F.last(F.when(units, F.col("text")), ignorenulls=True).over(ahead))


def library_passages(references: DataFrame, chunks: DataFrame, documents: DataFrame, pages: DataFrame, texts: DataFrame, questions: DataFrame, k: int = 6) -> DataFrame:
    """One passage per reference and source: ref_id, doc_id, chunk (null but for chunks), strategy, page, text.

    ``references``: ref_id, qid, title, summary; those with ``chunks`` (ref_id, chunk, text; the summary is none) give
    their best two, paged by the file page that holds their rows or else as printed. The others are looked up in
    ``documents`` (doc_id, pos, name) and read from its extracted ``pages`` (doc_id, page, text), or else from its plain
    ``texts`` (doc_id, text), paged by the nearest running head. ``questions``: qid, text, answer. What states no figure
    gives no passage.
    """
    asked = references.select("ref_id", "qid").join(questions, "qid").drop("qid")
    own = chunks.join(references.select("ref_id", F.coalesce("summary", F.lit("")).alias("_summary"), F.col("title").alias("doc_id")), "ref_id").filter((F.trim("text") != "") & (F.trim("text") != F.trim("_summary"))).drop("_summary")
    picked = best_chunks(own, asked, "ref_id", "doc_id")
    each = picked.select("ref_id", "doc_id", "chunk", chunk_page(F.col("text")).alias("printed"), F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(F.trim("text") != "")
    within = ["ref_id", "doc_id", "chunk"]
    by_chunk = _passages(asked, each.drop("printed"), within, k)
    rows = by_chunk.select(*within, F.explode(F.split("text", "\n")).alias("row")).filter(F.col("row").rlike(LOOSE_NUMBER) & printed_page(F.col("row")).isNull()).select(*within, squashed(F.col("row")).alias("row"))
    on_page = pages.select("doc_id", "page", F.explode(F.split("text", "\n")).alias("row")).select("doc_id", "page", squashed(F.col("row")).alias("row")).distinct()
    held = page_holding(rows.withColumn("_p", F.concat_ws("#", *within)).join(on_page, ["doc_id", "row"]), "_p", "page").select("_p", F.col("page").alias("file_page"))
    printed = each.select(*within, "printed").distinct()
    by_chunk = by_chunk.join(printed, within, "left").withColumn("_p", F.concat_ws("#", *within)).join(held, "_p", "left")
    first = by_chunk.select("ref_id", "doc_id", "chunk", F.lit("chunk").alias("strategy"), F.coalesce("file_page", "printed").alias("page"), "text")

    rest = references.join(own.select("ref_id").distinct(), "ref_id", "left_anti")
    found = matched_documents(rest, documents).join(rest.select("ref_id", "qid"), "ref_id")
    found = found.withColumn("_nth", F.row_number().over(Window.partitionBy("qid", "doc_id").orderBy("ref_id"))).filter("_nth = 1").drop("_nth")  # a document once for each question
    within = ["ref_id", "doc_id"]
    paged = found.select(*within).join(pages, "doc_id").select(*within, "page", F.posexplode(F.split("text", "\n")).alias("_l", "text")).filter(F.trim("text") != "")
    paged = paged.filter(printed_page(F.col("text")).isNull()).withColumn("line", F.row_number().over(Window.partitionBy(*within).orderBy("page", "_l"))).drop("_l")
    second = _on_one_page(asked, paged, within, k)
    second = second.select(*within, F.lit(None).cast("int").alias("chunk"), F.lit("pages").alias("strategy"), F.col("page").cast("int").alias("page"), "text")

    plain = found.select(*within).join(pages.select("doc_id").distinct(), "doc_id", "left_anti").join(texts, "doc_id").select(*within, F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(F.trim("text") != "")
    third = _in_plain_text(asked, plain, within, k).select(*within, F.lit(None).cast("int").alias("chunk"), F.lit("text").alias("strategy"), "page", "text")
    return first.unionByName(second).unionByName(third)


def _passages(asked: DataFrame, lines: DataFrame, within: list[str], k: int) -> DataFrame:
    """within, page (printed, of the first kept line) and text: a unit line if no header says it, the header of the
    table of the first kept line, and the kept lines."""
    placed = with_place(lines, within)
    kept = best_lines(asked, placed.filter(~F.col("is_head")).select(*within, "line", "text"), "ref_id", within, k).drop("text").join(placed, [*within, "line"])
    first = F.struct("line", "page", "unit", "header")
    one = kept.groupBy(*within).agg(F.min(first).alias("f"), F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("kept"))
    head = F.array_except(F.coalesce("f.header", F.array().cast("array<string>")), "kept")
    unit = F.when(F.col("f.unit").isNotNull() & (F.size(head) == 0) & ~F.array_contains("kept", F.col("f.unit")), F.array("f.unit")).otherwise(F.array().cast("array<string>"))
    return one.select(*within, F.col("f.page").alias("page"), F.array_join(F.concat(unit, head, "kept"), "\n").alias("text"))


def _told(kept: DataFrame, within: list[str], page: Column, unit: Column, head: Column) -> DataFrame:
    """within, page and text: the unit line, if it isn't kept and there is no header, the lines of the header that
    aren't kept, and the kept lines in order."""
    one = kept.groupBy(*within).agg(F.any_value(page).alias("page"), F.any_value(unit).alias("_unit"), F.any_value(head).alias("_head"), F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("_kept"))
    none = F.array().cast("array<string>")
    more = F.array_except(F.coalesce("_head", none), "_kept")
    first = F.when(F.col("_unit").isNotNull() & (F.size(more) == 0) & ~F.array_contains("_kept", F.col("_unit")), F.array("_unit")).otherwise(none)
    return one.select(*within, "page", F.array_join(F.concat(first, more, "_kept"), "\n").alias("text"))


def _on_one_page(asked: DataFrame, lines: DataFrame, within: list[str], k: int) -> DataFrame:
    """Of documents' lines (within, page, line, text, no running heads): of the k lines that say most, those in the table of
    the first one, or else on its page; with the table's header, or the nearest line that states a unit at or above
    the table or the line, on that page."""
    placed = with_place(lines.withColumnRenamed("page", "_page_no"), [*within, "_page_no"])
    of_table = Window.partitionBy(*within, "_page_no", "table")
    inside = F.col("table").isNotNull() & (F.count(F.lit(1)).over(of_table) > 1)
    begins = F.first("unit").over(of_table.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = placed.withColumns({"_table": F.when(inside, F.col("table")), "_unit": F.when(inside, begins).otherwise(F.col("unit"))})
    kept = best_lines(asked, lines.select(*within, "line", "text"), "ref_id", within, k).select(*within, "line").join(placed, [*within, "line"])
    first = F.min(F.struct("line", F.col("_page_no").alias("page"), F.col("_table").alias("table"), F.col("_unit").alias("unit"), "header")).over(Window.partitionBy(*within))
    kept = kept.withColumn("_first", first).filter((F.col("_page_no") == F.col("_first.page")) & (F.col("_first.table").isNull() | F.col("_table").eqNullSafe(F.col("_first.table"))))
    head = F.when(F.col("_first.table").isNotNull(), F.col("_first.header"))
    return _told(kept, within, F.col("_first.page"), F.col("_first.unit"), head)


def _in_plain_text(asked: DataFrame, lines: DataFrame, within: list[str], k: int) -> DataFrame:
    """Of documents' plain texts the k lines that say most, with the nearest line above the last of them that states a unit,
    paged by the running head at or above the first."""
    placed = with_place(lines, within)
    above = Window.partitionBy(*within).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_unit", F.last(F.when(F.col("text").rlike(UNIT_LINE), F.col("text")), ignorenulls=True).over(above))
    kept = best_lines(asked, placed.filter(~F.col("is_head")).select(*within, "line", "text"), "ref_id", within, k).select(*within, "line").join(placed, [*within, "line"])
    whole = Window.partitionBy(*within)
    kept = kept.withColumns({"_first": F.min(F.struct("line", "page")).over(whole), "_last": F.max(F.struct("line", "_unit")).over(whole)})
    return _told(kept, within, F.col("_first.page"), F.col("_last._unit"), F.lit(None).cast("array<string>"))


def web_passages(sources: DataFrame, pages: DataFrame, questions: DataFrame, k: int = 6) -> DataFrame:
    """One block per source of a web search that has a passage with figures: source_id, url, title, text. ``sources``:
    source_id, qid, url, title, snippets; without snippets the page (``pages``: url, html) is read. ``questions``: qid,
    text, answer."""
    asked = questions.join(sources.select("source_id", "qid"), "qid").drop("qid")
    given = F.filter(F.transform(F.coalesce("snippets", F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    shown = sources.withColumn("_given", given)
    read = shown.filter((F.size("_given") == 0) & F.col("url").isNotNull()).join(pages.dropDuplicates(["url"]), "url").select("source_id", html_paragraphs(F.col("html")).alias("paragraphs"))
    every = shown.filter(F.size("_given") > 0).select("source_id", F.col("_given").alias("paragraphs")).unionByName(read)
    lines = every.select("source_id", F.posexplode("paragraphs").alias("line", "text"))
    kept = best_lines(asked, lines, "source_id", ["source_id"], k)
    text = kept.groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return text.join(sources.select("source_id", "url", "title"), "source_id").select("source_id", "url", "title", normalised(F.col("text")).alias("text"))


def quoted_blocks(found: DataFrame, lines: DataFrame) -> DataFrame:
    """``found`` (answer_id, pos, block, line, page: quotes verified on a line of a block) as blocks that may be cited:
    answer_id, pos, cite, text: the table's header, the unit row above the line, and the line. The same line quoted twice is one
    block. ``lines``: block, line, text of all blocks."""
    placed = unit_rows(with_place(lines, ["block"]), ["block"])
    numbered = quote_ids(found, "answer_id", "pos", "block", "line")
    joined = numbered.join(placed.select("block", "line", "text", "unit_row", "header"), ["block", "line"])
    parts = F.concat(F.coalesce("header", F.array().cast("array<string>")), F.filter(F.array("unit_row"), lambda x: x.isNotNull()), F.array("text"))
    doc = F.regexp_extract("block", r"^(D\d+)", 1)
    return joined.select("answer_id", "pos", "block", F.concat(doc, F.lit(":p"), "page", F.lit(":c"), "quote_no").alias("cite"), F.array_join(F.array_distinct(parts), "\n").alias("text"))


def asked_document(answers: DataFrame, found: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers with their placeholders replaced, the quoted blocks): ``answers`` (answer_id, text with [CITE_1]),
    ``found`` the verified quotes of each (see ``quoted_blocks``; pos is the placeholder's number)."""
    blocks = quoted_blocks(found, lines)
    ids = blocks.select("answer_id", F.concat(F.lit("CITE_"), "pos").alias("placeholder"), "cite")
    text = expanded(answers, ids).withColumn("text", F.regexp_replace("text", r"\s+([.,;:])", "$1"))
    return text, blocks.select("answer_id", "block", F.col("cite").alias("block_id"), "text").dropDuplicates(["answer_id", "block_id"])
