"""Tokenizing text as the workloads define it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jsplit(text: Column) -> Column:
    r"""Split at runs of ASCII non-word characters.

    A leading empty token stays, trailing empty tokens go, the empty text gives one empty token and a text of
    separators alone gives none. Null gives null. The text is searched once: the lambda holds what was found.
    """
    last = lambda w: F.element_at(w, -1)
    whole = lambda w: F.when((last(w) != "") | (F.size(w) == 1), w)
    split = lambda w: whole(w).when((F.size(w) == 2) & (w[0] == ""), F.array().cast("array<string>")).otherwise(F.slice(w, 1, F.size(w) - 1))
    return F.when(text.isNotNull(), F.transform(F.array(F.split(text, r"\W+")), split)[0])


def token_count(text: Column) -> Column:
    return F.when(text.isNotNull(), F.size(jsplit(text))).cast("long")


#: The same split in DuckDB, for the checks.
JSPLIT_SQL = (
    r"case when text = '' then [''] when regexp_replace(text, '\W+$', '') = '' then []::varchar[] "
    r"else regexp_split_to_array(regexp_replace(text, '\W+$', ''), '\W+') end"
)
