"""Unicode forms of one string: one written form for text that looks the same, and folded words for loose comparison.

A letter's script set holds its own scripts, from the Unicode data, and those of the letters it is drawn like. The sets
of a word's letters are intersected: a word whose own scripts are more than one is mixed, one that is wholly of letters
with a Latin double may be Latin; either is spelled in a script of the intersection, Latin first.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import FULL_WIDTH, LATIN_STAND_IN, LOOK_ALIKE, ODD_SPACE, ZERO_WIDTH

# Drawn like a Latin letter only loosely, or used as symbols on their own; they count inside Latin words.
LOOSE_LOOK_ALIKE = {"α": "a", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "γ": "y", "κ": "k", "к": "k", "т": "t", "м": "m", "н": "h", "в": "b", "ԍ": "g"}

MARKS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff"
MATH_LETTERS = "\U0001d400-\U0001d7ff"
OTHER_SCRIPTS = "\u0370-\u03ff\u0400-\u052f\u0530-\u058f"

#: Text without any of these characters is already in the one form; valid in Java and in Python.
SUSPECT_CLASS = f"[{ZERO_WIDTH}{ODD_SPACE}{MARKS}{FULL_WIDTH}{MATH_LETTERS}{OTHER_SCRIPTS}{''.join(LATIN_STAND_IN)}]"

_SUSPECT = re.compile(SUSPECT_CLASS)
_ZERO = re.compile(f"[{ZERO_WIDTH}]")
_SPACE = re.compile(f"[{ODD_SPACE}]")
_WIDE = re.compile(f"[{FULL_WIDTH}{MATH_LETTERS}]")
_CLUSTER = re.compile(f"[^\\W\\d_][{MARKS}]+")
_TOKEN = re.compile(f"[^\\W_][\\w{MARKS}]*")
_NOT_LATIN = re.compile(f"[{OTHER_SCRIPTS}{''.join(LATIN_STAND_IN)}]")

#: Alphabets with upper and lower case that share drawn forms, told apart by the Unicode script property.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Coptic", "Cherokee", "Georgian", "Glagolitic")
_SCRIPT_RULES = {s: regex.compile(rf"\p{{Script_Extensions={s}}}") for s in SCRIPTS}


@lru_cache(65536)
def scripts(ch: str) -> frozenset[str]:
    """Scripts of a letter by the Unicode data; none for digits, marks and letters of other writing systems."""
    return frozenset(s for s, rule in _SCRIPT_RULES.items() if ch.isalpha() and rule.fullmatch(ch))


def _doubles(table: dict[str, str]) -> dict[str, dict[str, str]]:
    """Of each letter what it can be redrawn as: script -> letter, through the Latin letter it is drawn like."""
    drawn: dict[str, dict[str, str]] = {}
    for letter, latin in table.items():
        for s in scripts(letter):
            drawn.setdefault(latin, {"Latin": latin}).setdefault(s, letter)
    return {x: {s: letter for s, letter in drawn[latin].items() if s not in scripts(x)} for latin in drawn for x in {latin, *(k for k, v in table.items() if v == latin)}}


_STRICT, _ALL = _doubles(LOOK_ALIKE), _doubles(LOOK_ALIKE | LOOSE_LOOK_ALIKE)


def script_set(ch: str, loose: bool = False) -> frozenset[str]:
    """Scripts a letter can be read as: its own and those of the letters it is drawn like."""
    return scripts(ch) | frozenset((_ALL if loose else _STRICT).get(ch, ()))


def _in_all(letters: list[str], loose: bool = False) -> frozenset[str]:
    return frozenset.intersection(*(script_set(c, loose) for c in letters))


def _spelled_in(parts: str, script: str, loose: bool = True) -> str:
    table = _ALL if loose else _STRICT
    return unicodedata.normalize("NFC", "".join(c if script in scripts(c) else table.get(c, {}).get(script, c) for c in parts))


def _genuine(token: str) -> bool:
    """It has a letter of another script that no Latin letter looks like."""
    return any(scripts(c) and "Latin" not in script_set(c, loose=True) for c in unicodedata.normalize("NFD", token))


def _stand_ins(token: str) -> str:
    """ð and the like as đ where đ can stand: at a word's beginning or in capitals (elsewhere it's a letter of its own)."""
    if "þ" in token.lower() or any(c in "ðɖ" and token[i - 1].isalpha() for i, c in enumerate(token) if i):
        return token
    return "".join(LATIN_STAND_IN.get(c, c) for c in token)


def _resolve(token: str, near: list[str]) -> str:
    """The token in a script all of its letters can be read as; Latin first.

    Letters that only loosely look Latin count in a word with as many Latin letters. A word wholly of another script
    whose letters all have Latin doubles is Latin, but not beside a genuine word of that script. A word that no script
    fits is spelled in Latin as far as it goes if most of its letters are Latin.
    """
    parts = unicodedata.normalize("NFD", token)
    letters = [c for c in parts if scripts(c)]
    own = frozenset().union(*map(scripts, letters)) if letters else frozenset()
    if own <= {"Latin"}:
        return _stand_ins(token)
    latin = sum("Latin" in scripts(c) for c in letters)
    others = len(letters) - latin
    fits = _in_all(letters)
    if not latin:  # one or more other scripts: Latin if every letter has a Latin double
        if "Latin" not in fits or any(_genuine(x) and own & {s for c in x for s in scripts(c)} for x in near):
            return token
        return _stand_ins(_spelled_in(parts, "Latin", loose=False))
    if "Latin" in fits or latin >= others and "Latin" in _in_all(letters, loose=True):
        return _stand_ins(_spelled_in(parts, "Latin"))
    if rest := sorted(_in_all(letters, loose=True) - {"Latin"}):
        return _spelled_in(parts, rest[0])
    return _stand_ins(_spelled_in(parts, "Latin")) if latin > others else token


def _spell(text: str) -> tuple[str, bool]:
    """text with each token in one script, and whether a letter stood in for a Latin or Vietnamese one."""
    if not _NOT_LATIN.search(text):
        return text, False
    tokens = list(_TOKEN.finditer(text))
    out, at, changed = [], 0, False
    for i, m in enumerate(tokens):
        token = m.group()
        if _NOT_LATIN.search(token):
            near = [tokens[j].group() for j in (i - 1, i + 1) if 0 <= j < len(tokens)]
            spelled = _resolve(token, near)
            if spelled != token:
                changed |= any("Latin" in scripts(c) for c in spelled)
                out += [text[at : m.start()], spelled]
                at = m.end()
    return "".join([*out, text[at:]]), changed


def canonical_form(text: str | None) -> str | None:
    """One form for text that looks the same: composed, plain width, plain spaces, nothing invisible, one script a word.

    Tabs, line ends, genuine foreign words, symbols, superscripts and typographic quotes stay. None gives None.
    """
    if text is None or not _SUSPECT.search(text):
        return text if text is None or text.isascii() else unicodedata.normalize("NFC", text)
    text = _SPACE.sub(" ", _ZERO.sub("", text))
    text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    return unicodedata.normalize("NFC", _spell(unicodedata.normalize("NFC", text))[0])


def odd_forms(text: str | None) -> list[str]:
    """Which of full_width, apart_accent, no_width, odd_space, look_alike the text holds."""
    if text is None or not _SUSPECT.search(text):
        return []
    found = []
    if re.search(f"[{FULL_WIDTH}]", text):
        found.append("full_width")
    if any(_composes(m.group()) for m in _CLUSTER.finditer(_ZERO.sub("", text))):
        found.append("apart_accent")
    if _ZERO.search(text):
        found.append("no_width")
    if _SPACE.search(text):
        found.append("odd_space")
    plain = unicodedata.normalize("NFC", _SPACE.sub(" ", _ZERO.sub("", text)))
    if _spell(plain)[1] or re.search(f"[{MATH_LETTERS}]", text):
        found.append("look_alike")
    return found


def _composes(cluster: str) -> bool:
    base = LOOK_ALIKE.get(cluster[0], cluster[0])
    return any(len(unicodedata.normalize("NFC", x + cluster[1:])) < len(cluster) for x in {base, cluster[0]})


@lru_cache(65536)
def fold_char(ch: str) -> str:
    """A character without case, accents and odd form: letters and digits, or '' (vanishes), or ' ' (parts words)."""
    if _ZERO.match(ch):
        return ""
    out = []
    for c in unicodedata.normalize("NFKD", ch):
        c = LATIN_STAND_IN.get(c, LOOK_ALIKE.get(c, LOOSE_LOOK_ALIKE.get(c, c)))
        for x in unicodedata.normalize("NFKD", c.casefold()):
            x = "d" if x == "đ" else LOOK_ALIKE.get(x, x)
            if unicodedata.category(x) == "Mn":
                continue
            out.append(x if x.isalnum() else " ")
    folded = "".join(out)
    return folded if len(folded) < 2 or ch.isalpha() else " "


def fold(text: str) -> str:
    """text without case, accents (đ = d) and odd forms; runs of anything but letters and digits become one space."""
    return " ".join("".join(map(fold_char, text)).split())


def words(text: str | None) -> list[str]:
    """Folded words in order; none for None."""
    return [] if text is None else fold(text).split()


def canonical_column(column: Column) -> Column:
    """canonical_form over a string column."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(canonical_form, na_action="ignore")

    return run(column)


def words_column(column: Column) -> Column:
    """words over a string column; null gives an empty array."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: words(x) if isinstance(x, str) else [])

    return run(column)
