"""Same or near-same records across splits.

Edit-distance segment join over words. Both strings are put in one order of words (rare words first), where what two
multisets of words share is what their sequences share in order. An evaluation string of m words that may differ by k
insertions and deletions is cut into k + 1 segments; one of them stands untouched in every training string that is near
enough, at most k places away. Segments are joined together with the shared key (here a gold unit), and what meets is
verified by a banded dynamic program.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.arrays import gram_hashes, mix
from vellum.llm.text import words, words_column
from vellum.session import cut

#: A word in at least this part of all records is common; there are at most (mean words a record) / COMMON of them.
COMMON = 0.005
#: Words of a segment that are compared in the join (the first ones of a longer segment; what meets is verified whole).
SEGMENT = 3
#: Training classes of one unit that share join keys; a unit of more is spread over several tasks.
HOT = 5000
#: Words of strings times strings that the dynamic program takes at once; bounds a task's memory, not the result.
STEP = 60_000


def least_common(m: int, n: int) -> int:
    """Words two strings of m and n words must share: at least 0.8 of the longer's."""
    return -(-4 * max(m, n) // 5)


def most_edits(m: int) -> int:
    """Insertions and deletions between a string of m words and any string near enough."""
    return max(m + n - 2 * least_common(m, n) for n in range(-(-4 * m // 5), 5 * m // 4 + 1))


def ordered(text: str | None, common: dict[str, int]) -> tuple[list[int], int]:
    """Hashes of the words, rare ones first and common ones last by rank, and how many are rare. Equal words lie together."""
    rare, usual = [], []
    for w in words(text):
        (usual if w in common else rare).append(w)
    usual.sort(key=lambda w: (common[w], w))
    hashes = sorted(xxhash.xxh64_intdigest(w) >> 1 for w in rare)
    return hashes + [xxhash.xxh64_intdigest(w) >> 1 for w in usual], len(rare)


def segment_starts(m: int, rare: int, k: int) -> list[tuple[int, int]]:
    """k + 1 segments (start, length) of m words: one word each over the rare part, the rest of the words in long ones."""
    parts = min(k + 1, m)
    single = min(rare, parts - 1)
    rest, over = parts - single, m - single
    cuts = [single + over * i // rest for i in range(rest + 1)]
    return [(i, 1) for i in range(single)] + [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def segment_lengths(n: int) -> range:
    """Words of the join keys that segments outside the rare part of a string near one of n words may have.

    Segments are shortest where nothing is rare; over 60 words they have two words or more.
    """
    near = range(max(1, -(-4 * n // 5)), 5 * n // 4 + 1) if n <= 60 else range(0)
    return range(min((min(m // min(m, most_edits(m) + 1), SEGMENT) for m in near), default=2), SEGMENT + 1)


class Cells:
    """Join keys of strings as arrays: a hash of the words at a place and of the unit."""

    def __init__(self) -> None:
        self._lengths: dict[int, range] = {}

    def _keys(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        words = batch.column("words")
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        return starts, batch.column("rare").to_numpy(), [np.zeros(0, np.uint64), *(gram_hashes(flat, n) for n in range(1, SEGMENT + 1))], batch.column("unit").to_numpy().view(np.uint64)

    def _out(self, batch: pa.RecordBatch, owner: np.ndarray, place: np.ndarray, grams: np.ndarray, units: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        key = mix(grams ^ mix(units[owner])).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key), batch.column("class").take(pa.array(owner)), pa.array(place.astype(np.int32)), pa.array(sizes[owner].astype(np.int32))], names=["k", "class", "place", "size"])

    def segments(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of an evaluation string its k + 1 segments, by their first words."""
        for batch in batches:
            starts, rare, grams, units = self._keys(batch)
            sizes, rows = np.diff(starts), []
            for i, m in enumerate(sizes.tolist()):
                rows += [(i, at, 1 if at < rare[i] else min(length, SEGMENT)) for at, length in segment_starts(m, int(rare[i]), most_edits(m))]
            owner, place, length = (np.array([r[c] for r in rows], np.int64) for c in range(3))
            own = np.zeros(len(rows), np.uint64)
            for n in range(1, SEGMENT + 1):
                own[length == n] = grams[n][(starts[owner] + place)[length == n]]
            yield self._out(batch, owner, place, own, units, sizes)

    def substrings(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a training string its substrings that a segment's first words may be."""
        for batch in batches:
            starts, rare, grams, units = self._keys(batch)
            sizes = np.diff(starts)
            every = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(every)) - starts[every]
            for n in set(sizes.tolist()) - self._lengths.keys():
                self._lengths[n] = segment_lengths(n)
            for n in range(1, SEGMENT + 1):
                used = np.array([n in self._lengths[x] for x in sizes.tolist()], bool)[every]
                wanted = (at + n <= sizes[every]) & ((at >= rare[every]) & used | (n == 1) & (at < rare[every]))
                where = np.flatnonzero(wanted)
                yield self._out(batch, every[where], at[where], grams[n][where], units, sizes)


def shared_words(left: list[list[int]], right: list[list[int]], most: np.ndarray) -> np.ndarray:
    """Words in common of each two ordered strings, by dynamic programming within a band of `most` edits.

    Exact where the strings are within that many insertions and deletions; else a smaller number.
    """
    rows, band = len(left), int(most.max(initial=0))
    m = np.array([len(x) for x in left], np.int64)
    n = np.array([len(x) for x in right], np.int64)
    a = np.full((rows, int(m.max(initial=0)) + 1), -1, np.int64)
    b = np.full((rows, int(max(m.max(initial=0), n.max(initial=0))) + 2 * band + 2), -2, np.int64)
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        a[i, : len(x)] = x
        b[i, band : band + len(y)] = y
    far = 1 << 30
    place = np.arange(2 * band + 1)
    # edits[:, d] is the distance of the first i words of left and the first i + d - band of right
    edits = np.broadcast_to(np.where(place >= band, place - band, far), (rows, 2 * band + 1))
    answer = np.where(m == 0, n, far)
    for i in range(1, a.shape[1]):
        step = np.full_like(edits, far)
        step[:, :-1] = edits[:, 1:] + 1
        step = np.where(a[:, i - 1, None] == b[:, i - 1 : i + 2 * band], np.minimum(step, edits), step)
        step[:, : max(0, band - i)] = far
        # words put in: from the left along the row
        edits = np.minimum.accumulate(step - place, axis=1) + place
        edits[:, : max(0, band - i)] = far
        at = np.clip(n - i + band, 0, 2 * band)
        done = (m == i) & (np.abs(n - m) <= band)
        answer[done] = edits[np.flatnonzero(done), at[done]]
    return np.maximum(0, (m + n - np.minimum(answer, m + n)) // 2)


def _verified(left: list[list[int]], right: list[list[int]]) -> list[bool]:
    """Whether each two strings share enough words, by the banded program, strings of like length together."""
    out = [False] * len(left)
    order = sorted(range(len(left)), key=lambda i: max(len(left[i]), len(right[i])))
    at = 0
    while at < len(order):
        # as many rows at once as keep a step of the program small
        end = at + 1
        while end < len(order) and (end - at) * max(len(left[order[end]]), len(right[order[end]])) < STEP:
            end += 1
        part, at = order[at:end], end
        x, y = [left[i] for i in part], [right[i] for i in part]
        need = np.array([least_common(len(p), len(q)) for p, q in zip(x, y, strict=True)])
        edits = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)]) - 2 * need
        for i, ok in zip(part, shared_words(x, y, np.maximum(edits, 0)) >= need, strict=True):
            out[i] = bool(ok)
    return out


def overlaps(records: DataFrame, key: str, text: str, split: str, units: str) -> DataFrame:
    """Pairs of a training and an evaluation (dev, test) record that share a unit and at least 0.8 of their words.

    Columns train_id, eval_id, eval_split; words are folded and counted with repeats, measured against the longer
    record. Splits are compared trimmed and without case. Null keys, texts, splits and units, records without words and
    other splits are in no pair; repeated rows count once; a key with several texts or splits stands for each.

    Strings of the same words are one class; classes are joined and verified, and records only come in at the end. A
    unit of more than HOT training classes is spread over several tasks.
    """
    source = records.select(F.col(key).alias("id"), F.col(text).alias("text"), F.lower(F.trim(F.col(split))).alias("split"), F.expr(f"filter(array_distinct(`{units}`), x -> x is not null)").alias("units"))
    source = source.where("id is not null and text is not null and split in ('train', 'dev', 'test') and size(units) > 0").distinct()
    counted = source.select(F.explode(F.array_distinct(words_column(F.col("text")))).alias("word")).groupBy("word").count()
    n = source.count()
    # at most (mean words a record) / COMMON words
    common = {r["word"]: i for i, r in enumerate(counted.where(F.col("count") >= max(2, COMMON * n)).orderBy("count", "word").collect())}

    id_type = source.schema["id"].dataType.simpleString()

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [ordered(x, common) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "split", "units")), pa.array([x for x, _ in got], pa.list_(pa.int64())), pa.array([r for _, r in got], pa.int32())], names=["id", "split", "units", "words", "rare"]
            )

    listed = source.select("id", "text", "split", "units").mapInArrow(order, f"id {id_type}, split string, units array<string>, words array<long>, rare int").where("size(words) > 0")
    listed = cut(listed.select("id", "split", F.explode("units").alias("unit"), "words", "rare", F.xxhash64("words").alias("class"), (F.col("split") == "train").alias("train")))
    texts = listed.select("class", "words").dropDuplicates(["class"])
    held = listed.select("class", F.xxhash64("unit").alias("unit"), "words", "rare", "train").dropDuplicates(["class", "unit", "train"])

    schema = "k long, class long, place int, size int"
    # a unit's training classes in parts of HOT: a key is of one part, and evaluation classes meet every part
    sizes = held.where("train").groupBy("unit").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts"))
    placed = held.join(sizes, "unit").withColumn("part", F.when(F.col("train"), F.array(F.pmod(F.xxhash64("class"), "parts").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = placed.select("class", "words", "rare", "train", F.explode("part").alias("part"), "unit").withColumn("unit", F.xxhash64("unit", "part")).drop("part")
    probe = spread.where("not train").drop("train").mapInArrow(lambda b: Cells().segments(b), schema)
    build = spread.where("train").drop("train").mapInArrow(lambda b: Cells().substrings(b), schema)
    e = probe.select("k", F.col("class").alias("eval_class"), "place", "size").alias("e")
    t = build.select("k", F.col("class").alias("train_class"), "place", "size").alias("t")
    near = (F.abs(F.col("e.place") - F.col("t.place")) <= F.ceil(F.col("e.size") * 0.4) + 1) & (5 * F.col("t.size") >= 4 * F.col("e.size")) & (4 * F.col("t.size") <= 5 * F.col("e.size"))
    candidates = e.join(t, F.col("e.k") == F.col("t.k")).where(near).select("eval_class", "train_class").distinct()
    side = lambda name: texts.select(F.col("class").alias(f"{name}_class"), F.col("words").alias(f"{name}_words"))
    full = candidates.join(side("eval"), "eval_class").join(side("train"), "train_class").select("eval_class", "train_class", "eval_words", "train_words")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(_verified(batch.column("train_words").to_pylist(), batch.column("eval_words").to_pylist()), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("eval_class", "train_class")], names=["eval_class", "train_class"])

    alike = full.mapInArrow(check, "eval_class long, train_class long")
    evals = listed.where("not train").select(F.col("class").alias("eval_class"), "unit", F.col("id").alias("eval_id"), F.col("split").alias("eval_split"))
    trains = listed.where("train").select(F.col("class").alias("train_class"), "unit", F.col("id").alias("train_id"))
    return alike.join(evals, "eval_class").join(trains, ["train_class", "unit"]).where("eval_id <> train_id").select("train_id", "eval_id", "eval_split").distinct()


def overlap_report(pairs: DataFrame, records: DataFrame, key: str, split: str, source: str) -> DataFrame:
    """Per evaluation split and source: records, records with an overlap, pairs. A null source is a source of its own."""
    base = records.select(F.col(key).alias("eval_id"), F.lower(F.trim(F.col(split))).alias("split"), F.col(source).alias("source")).where("split in ('dev', 'test')").dropDuplicates(["eval_id", "split"])
    hits = pairs.groupBy("eval_id", F.col("eval_split").alias("split")).agg(F.count("*").alias("pairs"))
    return base.join(hits, ["eval_id", "split"], "left").groupBy("split", "source").agg(F.count("*").alias("questions"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).cast("long").alias("pairs"))
