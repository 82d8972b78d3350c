"""Mixing sources to target shares of all tokens.

Documents are counted by exact token length for each source. A source's budget is met by whole rounds over all its
documents, then by the same part of every length, and what is left by a bounded knapsack over the lengths that remain
(a subset-sum by bit sets). How many documents of each length that takes is turned into documents by seeded order.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import cut

#: The knapsack works on a rest of at most this many times the longest document.
REST = 4
#: Parts that documents of one source and length are ranked in, so that no length is ranked in one task.
BUCKETS = 64
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODINGS: dict[str, object] = {}


def _encoding(path: str, pattern: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def count_tokens(documents: DataFrame, text: str, vocabulary: str, keep: list[str], pattern: str = PATTERN) -> DataFrame:
    """keep columns and n_tokens: whole texts in tokens of the byte-level BPE vocabulary at that path (0 for null).

    The file is read where the job is started from and sent to the executors with it.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keep).schema.fields)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(name), pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(x)) if x else 0 for x in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return documents.select(*keep, F.col(text).alias("__text")).mapInArrow(steps, f"{schema}, n_tokens long")


def fit(counts: dict[int, int], budget: int, copies: int) -> dict[int, int]:
    """How many documents of each length (counting repeats) add up to budget, or as near below it as they come.

    counts: documents by length; each may be taken up to copies times. Whole rounds come first, then an equal part of
    every length, then a bounded knapsack for the rest; the result is at most budget, and equal to it wherever the
    remaining documents allow.
    """
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in counts.items())
    if not total or budget <= 0:
        return {}
    rounds = min(copies, budget // total)
    taken = {n: c * rounds for n, c in counts.items()}
    rest = budget - total * rounds
    if rounds == copies or not rest:
        return {n: c for n, c in taken.items() if c}
    left = dict(counts)  # one more round, in part
    share = rest / total
    for n, c in counts.items():
        k = int(c * share)
        taken[n] += k
        left[n] -= k
        rest -= n * k
    # bring the rest down to a few documents, longest first
    most = REST * max(counts)
    for n in sorted(left, reverse=True):
        if rest <= most:
            break
        k = min(left[n], (rest - most) // n + 1, rest // n)
        taken[n] += k
        left[n] -= k
        rest -= n * k
    # subset sums of what is left as bits, a step for each power of two of a length's count
    reach, parts, mask = 1, [], (1 << (rest + 1)) - 1
    for n in sorted(left):
        c, k = min(left[n], rest // n), 1
        while c > 0:
            k = min(k, c)
            parts.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            c, k = c - k, k * 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for n, k, before in reversed(parts):
        if not before >> at & 1:
            taken[n] += k
            at -= n * k
    return {n: c for n, c in taken.items() if c}


def plan_mix(lengths: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source and token length how many copies to take: source, n_tokens, docs, copies_wanted.

    lengths: source, n_tokens, docs (counted by Spark); targets: source, target_share, max_repeats. The total is the
    largest at which every source that has documents meets its share; shares of sources without documents are given to
    the others in proportion.
    """
    held = lengths.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("tokens"))
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = wanted.join(held.where("tokens > 0"), "source")
    scale = F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share")).over(Window.partitionBy(F.lit(1)))  # one row a target
    budgets = both.select("source", "max_repeats", F.floor(scale * F.col("target_share") + 1e-6).cast("long").alias("budget"))

    def steps(rows: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(rows["n_tokens"].tolist(), rows["docs"].tolist(), strict=True))
        chosen = fit(counts, int(rows["budget"].iloc[0]), int(rows["max_repeats"].iloc[0]))
        rows["copies_wanted"] = [chosen.get(n, 0) for n in rows["n_tokens"]]
        return rows[["source", "n_tokens", "docs", "copies_wanted"]]

    return lengths.join(F.broadcast(budgets), "source").groupBy("source").applyInPandas(steps, "source string, n_tokens long, docs long, copies_wanted long")


def mix(documents: DataFrame, key: str, text: str, source: str, targets: DataFrame, vocabulary: str, seed: int = 0) -> DataFrame:
    """Chosen documents: doc_id, source, n_tokens, copies (1 to the source's max_repeats).

    A document that is chosen beyond whole rounds is chosen by its seeded hash, ties by key. Documents of null source,
    of sources without a target, and empty or null texts are not chosen; a null key is a document like others; a key
    that comes twice counts twice. Without documents or targets the result is empty.
    """
    wanted = targets.where("target_share > 0 and max_repeats > 0").select(F.col("source").alias("wanted")).distinct()
    listed = documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    listed = listed.join(F.broadcast(wanted), F.col("source") == F.col("wanted"), "left_semi")
    sized = cut(count_tokens(listed, "text", vocabulary, ["doc_id", "source"]).where("n_tokens > 0"))
    bucket = sized.withColumn("order", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)))
    parts = bucket.groupBy("source", "n_tokens", "bucket").agg(F.count("*").alias("n"))
    plan = plan_mix(parts.groupBy("source", "n_tokens").agg(F.sum("n").alias("docs")), targets)
    # of each length, whole rounds for all and one more copy for the first extra documents, bucket by bucket
    before = F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.withColumn("before", F.coalesce(before, F.lit(0))).join(plan, ["source", "n_tokens"]).where("copies_wanted > 0")
    ranked = bucket.join(offsets, ["source", "n_tokens", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("source", "n_tokens", "bucket").orderBy("order", "doc_id")))
    copies = F.expr("copies_wanted div docs") + F.when(F.col("rank") <= F.expr("copies_wanted % docs"), 1).otherwise(0)
    return ranked.select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, max_repeats, documents, tokens, actual_share, most_copies (zeros where nothing)."""
    got = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    rows = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").na.fill(0, ["documents", "tokens", "most_copies"])
    rows = rows.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(1))))  # one row a target
    return rows.select("source", "target_share", "max_repeats", "documents", "tokens", F.when(F.col("all_tokens") > 0, F.round(F.col("tokens") / F.col("all_tokens"), 6)).otherwise(F.lit(0.0)).alias("actual_share"), "most_copies")
