"""Passages of held-out items inside a large corpus.

Min-hash containment. The unit that has to be contained is a run of `run` consecutive words, that is run - 4 shingles of
five words; its signature is the least of their hashes, so equal runs have equal signatures wherever they stand, and a
long text has few: about two in run - 4 words. The signatures of all items are one table and those of the corpus, read
once, another; they are joined on the signature, and the runs behind it are compared by the hash of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.arrays import WordArrays, gram_hashes, groups, sliding
from vellum.session import cut

SHINGLE = 5
#: If items have at most so many signatures (8 bytes each) the tasks know them and hand on only these; else all are joined.
KNOWN = 1_000_000
STEP = 400_000


def _signatures(hashes: np.ndarray, starts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every run inside a text: its first word, its text, the least of its shingle hashes."""
    shingles = gram_hashes(hashes, SHINGLE)
    if len(hashes) < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding(shingles, run - SHINGLE + 1, np.minimum)
    owner = np.searchsorted(starts, np.arange(len(least)), "right") - 1
    at = np.flatnonzero(np.arange(len(least)) + run <= starts[owner + 1])
    return at, owner[at], least[at]


def _runs(texts: DataFrame, run: int, known=None) -> DataFrame:
    """Of texts (id, text) the runs by signature: id, sig, runs (hashes of the whole runs behind it); of known ones only."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = WordArrays()
        for batch in batches:
            ids, held = batch.column("id"), batch.column("text").to_pylist()
            for piece in groups([len(x) for x in held], STEP):
                words, starts = split.split(held[piece])
                at, owner, least = _signatures(words, starts, run)
                if known is not None and len(at):
                    near = np.minimum(np.searchsorted(known.value, least), len(known.value) - 1)
                    hit = known.value[near] == least
                    at, owner, least = at[hit], owner[hit], least[hit]
                if not len(at):
                    continue
                whole = gram_hashes(words, run)[at]
                order = np.lexsort((whole, least, owner))
                owner, least, whole = owner[order], least[order], whole[order]
                first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (least[1:] != least[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(whole)].astype(np.int32)), pa.array(whole.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner[first] + piece.start)), pa.array(least[first].view(np.int64)), lists], names=["id", "sig", "runs"])

    return texts.mapInArrow(steps, f"id {texts.schema['id'].dataType.simpleString()}, sig long, runs array<long>")


def contained_items(documents: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, passage: str, run: int = 25) -> DataFrame:
    """Documents that hold at least run consecutive words of an item's passage: doc_id, item_id, once each.

    Words are compared without case, accents, punctuation, spacing and odd character forms. Null texts and passages and
    those of fewer than run words are in no pair; null keys take no part; repeated rows count once.
    """
    texts = lambda df, key, column: df.where(F.col(key).isNotNull() & (F.length(column) >= 2 * run - 1)).select(F.col(key).alias("id"), F.col(column).alias("text"))
    wanted = cut(_runs(texts(items, item_key, passage).distinct(), run))
    few = wanted.select("sig").distinct().limit(KNOWN + 1).toArrow().column("sig").to_numpy().view(np.uint64)
    known = documents.sparkSession.sparkContext.broadcast(np.sort(few)) if 0 < len(few) <= KNOWN else None
    held = _runs(texts(documents, doc_key, text), run, known)
    pairs = held.select(F.col("id").alias("doc_id"), "sig", F.col("runs").alias("own")).join(wanted.select(F.col("id").alias("item_id"), "sig", "runs"), "sig")
    return pairs.where(F.arrays_overlap("own", "runs")).select("doc_id", "item_id").distinct()


def leak_report(found: DataFrame, items: DataFrame, item_key: str = "item_id", split: str = "split", source: str = "source") -> DataFrame:
    """Per split and source of the items: items, leaked items, documents that hold any of them."""
    base = items.dropDuplicates([item_key]).select(F.col(item_key).alias("item_id"), F.col(split).alias("split"), F.col(source).alias("source"))
    # an item's documents are counted before the join, so that an item found everywhere moves one row
    per_item = found.groupBy("item_id").agg(F.count("*").alias("hits"))
    return base.join(per_item, "item_id", "left").groupBy("split", "source").agg(F.count("*").alias("items"), F.count("hits").alias("leaked_items"), F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("hits"))
