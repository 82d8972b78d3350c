"""Characters that look the same, and the one form in which ids and hashes are compared."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts drawn like a Latin letter in common typefaces.
LOOK_ALIKE = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    # Greek
    "ο": "o", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N",
    "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ϲ": "c", "ϳ": "j",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "Օ": "O", "Ս": "U",
}
# Latin letters that stand in for a Vietnamese or plain Latin one.
LATIN_STAND_IN = {"ð": "đ", "Ð": "Đ", "ɖ": "đ", "Ɖ": "Đ", "ı": "i", "ɑ": "a", "ɡ": "g"}

ZERO_WIDTH = "\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff"
ODD_SPACE = "\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
FULL_WIDTH = "\uff01-\uff5e\uffe0-\uffe6"


def _members(ranges: str) -> list[str]:
    """Characters of a class written as single characters and ranges."""
    out, i = [], 0
    while i < len(ranges):
        wide = ranges[i + 1 : i + 2] == "-"
        out += map(chr, range(ord(ranges[i]), ord(ranges[i + 2 if wide else i]) + 1))
        i += 3 if wide else 1
    return out


#: Every character that an id may hold in place of a plain one.
PLAIN = str.maketrans(
    LOOK_ALIKE | LATIN_STAND_IN | dict.fromkeys(_members(ZERO_WIDTH), "") | dict.fromkeys(_members(ODD_SPACE), " ") | {c: unicodedata.normalize("NFKC", c) for c in _members(FULL_WIDTH)}
)


def plain_id(text: str) -> str:
    """An id in plain letters: ids are of one script, so every look-alike is its Latin or Vietnamese letter."""
    return unicodedata.normalize("NFC", text.translate(PLAIN)).upper().strip()


def key_form(column: Column) -> Column:
    """Ids and hashes written differently in one form: plain letters, composed, trimmed, in capitals; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(plain_id, na_action="ignore")

    return run(column)
