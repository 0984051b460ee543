"""Text functions on columns: all of them built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from numerant.lexicon import BLOCK_TAGS, FOOTNOTE_MARKS, INLINE_FORMULA, LOOSE_NUMBER, NUMBER, PAGE_HEADS, SKIPPED_TAGS, WORD


# Odd blanks, a minus and superscripts, and what a text must hold for ``normalised`` to change it.
_ODD = "    −¹²³⁴⁵⁶⁷⁸⁹⁰"
_MARKED = r"[*^\\\t\xa0\xb2\xb3\xb9 -  ⁰-⁹−]|  "  # ranges, as every single sign slows the search down


def normalised(text: Column) -> Column:
    """Markup of answers and tables taken off: bold, footnote marks, escapes, LaTeX, superscripts, odd blanks. Texts that hold
    nothing of these, which one search tells, stay as they are."""
    t = F.replace(text, F.lit("**"), F.lit(""))
    for mark in FOOTNOTE_MARKS:
        t = F.regexp_replace(t, mark, "")
    t = F.replace(t, F.lit("\\$"), F.lit("$"))
    t = F.regexp_replace(t, INLINE_FORMULA, "$1")
    t = F.replace(F.replace(t, F.lit("\\%"), F.lit("%")), F.lit("\\times"), F.lit("x"))
    t = F.replace(F.replace(t, F.lit("m³"), F.lit("m3")), F.lit("m²"), F.lit("m2"))
    t = F.translate(t, _ODD, "    -")
    return F.when(text.rlike(_MARKED), single_blanks(t)).otherwise(text)


def single_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t]{2,}|\t", " ")


def number_tokens(text: Column) -> Column:
    """Every number as written, in order."""
    return F.regexp_extract_all(text, F.lit(NUMBER), 0)


def loose_numbers(text: Column) -> Column:
    """The set of numbers, without separators."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LOOSE_NUMBER), 0)
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(""))))


def quoted_numbers(text: Column) -> Column:
    """The set of numbers without the years that give context."""
    return loose_numbers(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<![\d,.])(?:19|20)\d{2}(?![\d,.])", " "))


def flattened(text: Column) -> Column:
    """Lower case, without bold and cell borders, single blanks."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("**"), F.lit(" ")), F.lit("|"), F.lit(" "))
    return F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(flattened(text), F.lit(WORD), 0))


def squashed(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(unescaped(F.coalesce(text, F.lit(""))), r"[\s*]+", " ")))


def row_cells(line: Column) -> Column:
    """The cells of a Markdown table row."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.trim(c))


def is_separator_row(line: Column) -> Column:
    """Whether all cells that aren't empty, and there is one, are a run of dashes with optional colons."""
    cells = F.filter(row_cells(line), lambda c: c != "")
    return (F.size(cells) > 0) & F.forall(cells, lambda c: c.rlike(r"^:?-{2,}:?$"))


def unescaped(text: Column) -> Column:
    """The common character references decoded, the ampersand last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_paragraphs(html: Column) -> Column:
    """The paragraphs of a page longer than 20 characters, without title, scripts, navigation and the like."""
    t = F.coalesce(html, F.lit(""))
    for tag in [*SKIPPED_TAGS, "title"]:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    t = F.regexp_replace(t, r"\s+", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{'|'.join(BLOCK_TAGS)})\b[^>]*>", "\n")
    t = unescaped(F.regexp_replace(t, r"<[^>]*>", ""))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.filter(lines, lambda x: F.length(x) > 20)


def domain(url: Column) -> Column:
    """The host without ``www.``; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def safe_url(url: Column) -> Column:
    """The URL if it is http or https, else null."""
    return F.when(url.rlike(r"(?i)^https?://"), url)


def printed_page(line: Column) -> Column:
    """The page number of a running header ("140 Annual Report 2024 | ..." or "... | Governance 57"), else null."""
    found = [F.regexp_extract(line, p, 1) for p in PAGE_HEADS]
    return F.coalesce(*[F.when(f != "", f.cast("int")) for f in found])
