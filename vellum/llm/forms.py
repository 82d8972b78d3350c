"""Text that looks the same but is made of other characters, in one consistent form.

The script sets of a word's letters (a letter's own script and those of its look-alikes) are intersected; the word is
spelled in a script all its letters have, Latin first, which finds words of mixed scripts and words wholly made of
another script's look-alikes. What remains (full width, accents apart from their letter, characters of no width, other
spaces) is normalized. The rules for one string are in vellum.llm.text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.arrays import TextScan
from vellum.llm.text import SUSPECT_CLASS, canonical_column, canonical_form, odd_forms


def odd_texts(records: DataFrame, key: str | Column, text: str | Column) -> DataFrame:
    """Records whose text holds odd forms: record_key, kinds (array), canonical.

    A scan over code points picks the few texts with a suspicious character; only these are looked at word by word. Null keys and texts are
    skipped; a repeated row comes out again; empty text holds nothing.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    source = records.select(col(key).cast("string").alias("record_key"), col(text).alias("text")).where("record_key is not null and text is not null")
    scan = TextScan(SUSPECT_CLASS)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [(i, kinds) for i in scan(texts) if (kinds := odd_forms(texts[i]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("record_key").take(pa.array([i for i, _ in found], pa.int64())), pa.array([k for _, k in found], pa.list_(pa.string())), pa.array([canonical_form(texts[i]) for i, _ in found], pa.string())],
                names=["record_key", "kinds", "canonical"],
            )

    return source.mapInArrow(steps, "record_key string, kinds array<string>, canonical string")


def canonical_texts(records: DataFrame, text: str, result: str) -> DataFrame:
    """records with one more column: text in the one form (null stays null).

    Texts without a suspicious character take the short way inside the function; rows, order and other columns stay.
    """
    return records.withColumn(result, canonical_column(F.col(text)))
