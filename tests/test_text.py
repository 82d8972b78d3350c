"""The one form of ids and hashes."""

import pytest
from pyspark.sql import functions as F

from vellum.functions.text import key_form, plain_id

CASES = [(" 20365​/2017/nđ-ср ", "20365/2017/NĐ-CP"), ("20098/2021/NƉ-CP", "20098/2021/NĐ-CP"), ("２０/2020／QН15", "20/2020/QH15"), ("QÐ\xa01", "QĐ 1"), ("abcо́", "ABCÓ"), ("", ""), ("　x\t", "X")]


@pytest.mark.parametrize(("text", "form"), CASES)
def test_plain_id(text, form):
    assert plain_id(text) == form == plain_id(form)


def test_key_form(spark):
    df = spark.createDataFrame([(x,) for x, _ in CASES] + [(None,)], "id string")
    assert [r[0] for r in df.select(key_form(F.col("id"))).collect()] == [y for _, y in CASES] + [None]
