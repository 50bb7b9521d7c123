"""Documents inside larger marked-up texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAGE = r"(?s)<title>(.*?)</title>.*?<text[^>]*>(.*?)</text>"


def escaped(text: Column) -> Column:
    """Text as it stands inside an element."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``."""
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def wiki_pages(dumps: DataFrame, column: str = "value") -> DataFrame:
    """(key, value) = (title, text) of every page in a column of dump texts; line breaks become blanks, and the marks
    for &, < and > become these characters."""
    titles = F.regexp_extract_all(column, F.lit(_PAGE), F.lit(1))
    texts = F.regexp_extract_all(column, F.lit(_PAGE), F.lit(2))
    return dumps.select(F.inline(F.arrays_zip(titles.alias("key"), texts.alias("value")))).select(unescaped(F.col("key")).alias("key"), unescaped(F.regexp_replace("value", r"\s*[\r\n]+\s*", " ")).alias("value"))


def html_titles(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id and the text of the first title element; empty if there is none."""
    return pages.select("page_id", F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).alias("title"))
