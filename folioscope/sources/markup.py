"""Text out of markup: web pages, wiki pages, Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _without(text: Column, patterns: tuple[str, ...], by: str = " ") -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, by)
    return text


def plain(html: Column) -> Column:
    """Text of a page: no scripts, styles, comments and tags; white space collapsed."""
    bare = _without(html, (r"(?is)<(script|style)\b.*?</(script|style)>", r"(?s)<!--.*?-->", r"<[^>]+>"))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def wiki_text(source: Column) -> Column:
    """Text of a wiki page: no references, templates, tables and files; links by their labels; no emphasis marks."""
    bare = _without(source, (r"(?s)<!--.*?-->", r"(?is)<ref[^>]*/>", r"(?is)<ref[^>]*>.*?</ref>"), "")
    for _ in range(3):  # templates nest
        bare = F.regexp_replace(bare, r"(?s)\{\{[^{}]*\}\}", "")
    bare = _without(bare, (r"(?s)\{\|.*?\|\}", r"(?i)\[\[(?:file|image|category|файл|категория):[^\[\]]*(?:\[\[[^\]]*\]\][^\[\]]*)*\]\]"), "")
    bare = F.regexp_replace(bare, r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1")
    bare = _without(bare, (r"</?[a-zA-Z][^>]*>", r"'{2,}"), "")
    return F.trim(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def sections(text: Column) -> Column:
    """(title, body) by headings of the form == title ==; what stands first has an empty title."""
    parts = F.split(F.concat(F.lit("== ==\n"), text), r"(?m)^==+\s*", -1)
    cut = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(F.trim(F.regexp_extract(p, r"^(.*?)\s*==+\s*(?:\n|\z)", 1)).alias("title"), F.regexp_replace(F.regexp_replace(p, r"^.*?==+\s*(?:\n|\z)", ""), r"^\s+|\s+\z", "").alias("body")))
    return F.filter(cut, lambda s: s["body"] != "")


def table_rows(text: Column) -> Column:
    """Rows of a Markdown table as maps from the header's names to cells; the ruler row is left out."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: F.regexp_like(x, F.lit(r"^\s*\|.*\|\s*$")))
    cells = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\s*\||\|\s*$", ""), r"(?<!\\)\|"), lambda c: F.trim(c))
    head = F.when(F.size(lines) > 0, cells(F.get(lines, 0)))
    body = F.filter(F.slice(lines, 2, 1_000_000), lambda x: ~F.regexp_like(x, F.lit(r"^[\s|:-]+$")))
    return F.transform(body, lambda x: F.map_from_entries(F.filter(F.arrays_zip(head.alias("k"), cells(x).alias("v")), lambda p: p["k"].isNotNull())))


def principles(catalog: DataFrame, least: int, text_col: str = "text", key: str = "id") -> DataFrame:
    """Principles of a catalog, a row each; too few, a repeated key or a row without one is an error."""
    rows = catalog.select(F.explode(table_rows(F.col(text_col))).alias("row"))
    found = rows.select(F.col("row")[key].alias("principle"), "row")
    n, distinct, bad = found.agg(F.count(F.lit(1)), F.countDistinct("principle"), F.count_if(F.coalesce(F.col("principle"), F.lit("")) == "")).first()
    if bad or distinct != n or n < least:
        raise ValueError(f"bad catalog: {n} rows, {distinct} different keys, {bad} without one, {least} needed")
    return found
