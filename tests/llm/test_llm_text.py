"""Unicode forms and folding."""

import unicodedata

import pytest

from vellum.functions.text import LOOK_ALIKE
from vellum.llm.text import canonical_form, fold, odd_forms, script_set, scripts, words

CASES = [
    ("Tо̂̉ Đạі", "Tổ Đại"), ("QН15", "QH15"), ("20098/2021/NƉ-CP", "20098/2021/NĐ-CP"), ("NĐ-СР", "NĐ-CP"),
    ("“Москва” α Δ Ω m²", "“Москва” α Δ Ω m²"), ("ðăng", "đăng"), ("КV-1", "KV-1"), ("на дорога", "на дорога"),
    ("a​b c　d", "ab c d"), ("ＡＢ１！", "AB1!"), ("abîmé Øster", "abîmé Øster"), ("Guðrún", "Guðrún"), ("кhi", "khi"), ("", ""), ("\t\r\n", "\t\r\n"), ("Mосква", "Москва"),
]


@pytest.mark.parametrize(("text", "form"), CASES)
def test_canonical_form(text, form):
    assert canonical_form(text) == form
    assert canonical_form(form) == form


def test_script_sets_come_from_unicode_data():
    assert scripts("a") == {"Latin"} and scripts("а") == {"Cyrillic"} and scripts("α") == {"Greek"} and scripts("ա") == {"Armenian"} and scripts("5") == frozenset()
    assert script_set("а") == {"Cyrillic", "Latin"} and script_set("Ж") == {"Cyrillic"} and {"Latin", "Cyrillic", "Greek"} <= script_set("O")
    assert all(unicodedata.name(c).split()[0].title() in scripts(c) for c in LOOK_ALIKE)


def test_forms_of_nothing():
    assert canonical_form(None) is None and odd_forms(None) == [] and words(None) == [] and words("") == []


def test_clean_texts_have_no_odd_forms():
    assert all(odd_forms(form) == [] for _, form in CASES)


def test_fold():
    assert fold("Điều 5, KHOẢN  a) - m².") == "dieu 5 khoan a m2"
    assert words("Tо̂̉​ chức đường") == ["to", "chuc", "duong"]
