"""HTML to text with stable line boundaries, and reviewed literal corrections."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags that end a line, and tags whose content isn't text.
BLOCK_TAGS = ("article", "br", "div", "h1", "h2", "h3", "li", "p", "section", "tr")
SKIPPED_TAGS = ("script", "style")

#: Comments, declarations, end tags without a name, and skipped tags with all they hold (to the end if never closed).
_NO_TEXT = rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(SKIPPED_TAGS)})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z)|<[!?][^>]*>|</(?![a-z])[^>]*>"
_NAMED = rf"(?:{'|'.join(BLOCK_TAGS)})(?=[\s/>])"
_REST = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
_INLINE, _BLOCK = rf"(?i)</?(?!{_NAMED})[a-z]{_REST}", rf"(?i)(?:</?{_NAMED}{_REST})+"


def _characters(column: Column) -> Column:
    """Character references as the characters they stand for, composed."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: unicodedata.normalize("NFC", html.unescape(x)), na_action="ignore")

    return run(column)


def html_column(column: Column) -> Column:
    """Composed text of HTML: block tags break lines, runs of blanks are one, at most one empty line; null stays null.

    Marks are taken away kind by kind before references are read, so that a written &lt;p&gt; stays text.
    """
    text = column
    for rule, instead in ((_NO_TEXT, ""), (_INLINE, ""), (_BLOCK, "\n")):
        text = F.regexp_replace(text, rule, instead)
    text = _characters(text)
    blanks = ((r"\r\n?", "\n"), (r"(?U)[\s\x1c-\x1f&&[^\n]]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^[ \n]+|[ \n]+\z", ""))
    for rule, instead in blanks:
        text = F.regexp_replace(text, rule, instead)
    return text


def replace_counts(text: Column, find: Column) -> Column:
    """How often find stands in text without overlap; 0 for an empty find, null for nulls."""
    return F.when(F.length(find) > 0, ((F.length(text) - F.length(F.replace(text, find, F.lit("")))) / F.length(find)).cast("long")).otherwise(F.lit(0).cast("long"))


def corrected(text: Column, corrections: Column) -> Column:
    """Text after literal corrections in order (array of struct find, replace, expected_count), counts included.

    Gives struct(text, wrong): wrong lists 'n of expected: find' for corrections whose count on the text so far isn't the
    expected one; a null array corrects nothing.
    """

    def step(state: Column, c: Column) -> Column:
        n = replace_counts(state["text"], c["find"])
        wrong = F.when(n == c["expected_count"], state["wrong"]).otherwise(F.concat(state["wrong"], F.array(F.concat_ws(": ", F.concat_ws(" of ", n.cast("string"), c["expected_count"].cast("string")), c["find"]))))
        return F.struct(F.replace(state["text"], c["find"], c["replace"]).alias("text"), wrong.alias("wrong"))

    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("wrong"))
    return F.when(corrections.isNull(), start).otherwise(F.aggregate(corrections, start, step))
