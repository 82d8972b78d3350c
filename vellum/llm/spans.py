"""Long exact runs of text that stand in more than one record.

Compact windows over the min-hashes of character grams: a run of `run` characters holds run - gram + 1 grams, and the
least gram hash among them is least in the same place in every text that holds the run. For each text only the grams
that are least in some stretch of that many grams are kept (about 2 in run - gram + 2 characters), each with how far to
both sides no smaller gram stands: the widest window of a Cartesian tree node. Only windows whose hash stands in more than
one text are looked into; each of their runs goes to its class by the hash of all its characters. Coverage follows from
the places of shared runs; pairs follow from the first run of each stretch with the same holders, and the characters of
these are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.arrays import code_points, gram_hashes, groups, sliding
from vellum.session import cut

#: Characters per numpy step (longer texts take several); bounds a task's memory, not the result.
STEP = 400_000


def _room(levels: list[np.ndarray], at: np.ndarray, own: np.ndarray, step: int) -> np.ndarray:
    """How many grams beside each position (step 1: after, -1: before) are no smaller, as far as the levels reach."""
    n, room = len(levels[0]), np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        reach = 1 << k
        first = at + 1 + room if step > 0 else at - room - reach
        ok = (first >= 0) & (first + reach <= n)
        ok[ok] = levels[k][first[ok]] >= own[ok]
        room += reach * ok
    return room


def compact_windows(texts: list[str], run: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, gram hash, position, grams free to the left, to the right) of every window's least gram."""
    points, starts = code_points(texts)
    width = run - gram + 1
    hashes = gram_hashes(points, gram)
    if len(hashes) < width:
        return (np.zeros(0, np.int64),) * 5
    owner = np.searchsorted(starts, np.arange(len(hashes)), "right") - 1
    least = sliding(hashes, width, np.minimum)
    # a window that leaves its text doesn't count
    least[np.arange(len(least)) + run > starts[owner[: len(least)] + 1]] = 0
    padded = np.zeros(len(hashes) + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero((sliding(padded, width, np.maximum) == hashes) & (hashes > 0))
    own = hashes[at]
    levels = [hashes]
    while 1 << len(levels) <= width:
        reach = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-reach], levels[-1][reach:]))
    text = owner[at]
    left = np.minimum(_room(levels, at, own, -1), at - starts[text])
    right = np.minimum(_room(levels, at, own, 1), starts[text + 1] - gram - at)
    return text, own.view(np.int64), at - starts[text], left, right


def _parts(text: str, run: int) -> Iterator[tuple[int, str]]:
    """A long text in parts (begin, part); every run begins in one of them and lies whole in it."""
    for begin in range(0, max(1, len(text) - run + 1), STEP):
        yield begin, text[begin : begin + STEP + run - 1]


def _windows(source: DataFrame, run: int, gram: int) -> DataFrame:
    """The hashes of each text's windows, once each: h, tid."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("tid").to_numpy()
            parts = [(i, part) for i, text in enumerate(batch.column("text").to_pylist()) for _, part in _parts(text, run)]
            for some in groups([len(x) for _, x in parts], STEP):
                owner = np.array([i for i, _ in parts[some]])
                text, h, *_ = compact_windows([x for _, x in parts[some]], run, gram)
                rows = np.unique(np.stack([ids[owner[text]], h], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), pa.array(rows[:, 0])], names=["h", "tid"])

    return source.mapInArrow(steps, "h long, tid long")


def _run_hashes(held: DataFrame, run: int, gram: int) -> DataFrame:
    """Every run of the windows of the given hashes by the hash of all its characters: h, tid, at (where it begins); each once."""
    width = run - gram

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, text, hashes in zip(*(batch.column(c).to_pylist() for c in ("tid", "text", "hashes")), strict=True):
                for begin, part in _parts(text, run):
                    _, least, at, left, right = compact_windows([part], run, gram)
                    # a window's least gram is least in the runs that begin from first to last
                    first, last = at - np.minimum(left, width), at + np.minimum(right, width) - width
                    used = np.isin(least, hashes) & (first <= last)
                    edge = np.zeros(len(part) + 2, np.int64)
                    np.add.at(edge, first[used], 1)
                    np.add.at(edge, last[used] + 1, -1)
                    h = gram_hashes(code_points([part])[0], run)
                    where = np.flatnonzero(np.cumsum(edge)[: len(h)] > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(h[where].view(np.int64)), pa.array(np.full(len(where), tid, np.int64)), pa.array((where + begin).astype(np.int32))], names=["h", "tid", "at"])

    return held.mapInArrow(steps, "h long, tid long, at int")


def _texts(records: DataFrame, key: str, text: str, run: int) -> DataFrame:
    source = records.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= run))
    return source.withColumn("tid", F.xxhash64("text"))


def _shared(source: DataFrame, run: int) -> tuple[DataFrame, DataFrame]:
    """(runs that stand in more than one text, the texts that may hold such runs: tid, text).

    Runs: tid, at, holders (which texts hold the run, as a fingerprint). Copies of a text are one.
    """
    gram = max(1, run // 2)
    # hashes are compared over their rows where these are sorted (16 and 20 bytes a row, spilled if many): nothing is
    # brought together that grows with how many texts hold a run
    alike = Window.partitionBy("h")
    several = F.min("tid").over(alike) < F.max("tid").over(alike)
    meeting = _windows(source.select("tid", "text"), run, gram).withColumn("several", several).where("several").groupBy("tid").agg(F.collect_set("h").alias("hashes"))  # bounded by the text
    held = cut(source.select("tid", "text").join(meeting, "tid").groupBy("tid").agg(F.first("text").alias("text"), F.first("hashes").alias("hashes")))
    # two sums over hashes of the holders stand for the set of them
    half = lambda bits: F.sum(F.shiftrightunsigned(F.xxhash64("tid"), bits).bitwiseAND(0x7FFFFFFF)).over(alike)
    runs = _run_hashes(held, run, gram).select("tid", "at", several.alias("several"), F.xxhash64(F.count("*").over(alike), half(0), half(32)).alias("holders"))
    return runs.where("several").select("tid", "at", "holders"), held.select("tid", "text")


def shared_pairs(records: DataFrame, key: str, text: str, run: int = 150) -> DataFrame:
    """Pairs of records that share a run of at least `run` characters, as stored: id_a, id_b (id_a first by order).

    Null keys and texts and texts shorter than run take no part; rows repeated as a whole count once; a key with several
    texts stands for all of them; empty input gives no rows. Copies of a text are compared as one text. Of the runs that
    the same texts share one after the other only the first makes pairs, and its characters are compared.
    """
    source = _texts(records, key, text, run)
    shared, texts = _shared(source, run)
    order = Window.partitionBy("tid").orderBy("at")
    same = (F.lag("at").over(order) == F.col("at") - 1) & (F.lag("holders").over(order) == F.col("holders"))
    firsts = shared.withColumn("goes_on", F.coalesce(same, F.lit(False))).where("not goes_on").select("tid", "at")
    slices = cut(firsts.join(texts, "tid").select("tid", F.expr(f"substring(text, at + 1, {run})").alias("slice")).withColumn("h", F.xxhash64("slice")).distinct())
    side = lambda name: slices.select("h", F.col("tid").alias(f"tid_{name}"), F.col("slice").alias(f"slice_{name}"))
    pairs = side("a").join(side("b"), "h").where("tid_a < tid_b and slice_a = slice_b").select("tid_a", "tid_b").distinct()
    members = source.select("tid", "id").distinct()
    member = lambda name: members.select(F.col("tid").alias(f"tid_{name}"), F.col("id").alias(f"id_{name}"))
    other = pairs.join(member("a"), "tid_a").join(member("b"), "tid_b").select("id_a", "id_b")
    copies = cut(members.join(members.groupBy("tid").count().where("count > 1").select("tid"), "tid", "left_semi"))
    alike = copies.select("tid", F.col("id").alias("id_a")).join(copies.select("tid", F.col("id").alias("id_b")), "tid").select("id_a", "id_b")
    return other.where("id_a <> id_b").unionByName(alike.where("id_a < id_b")).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def shared_share(records: DataFrame, key: str, text: str, run: int = 150) -> DataFrame:
    """For each key how much of its text stands elsewhere too: id, chars, shared_chars, share.

    A character is shared if it lies in a run of at least `run` characters that a record of another key holds. It is
    read from the places of shared runs, without pairs, so that a passage in every record costs no more than its places.
    chars is the length of the key's longest text; of several texts the one with most shared characters counts. Keys
    without shared runs have shared_chars 0; an empty or null text has share 0.
    """
    source = _texts(records, key, text, run)
    shared, _ = _shared(source, run)
    after = F.lead("at").over(Window.partitionBy("tid").orderBy("at"))
    covered = shared.select("tid", "at").distinct().withColumn("after", after).groupBy("tid").agg(F.sum(F.least(F.lit(run), F.coalesce(F.col("after") - F.col("at"), F.lit(run)))).alias("covered"))
    held = source.select("tid", "id", F.length("text").alias("length")).distinct()
    sizes = held.groupBy("tid").agg(F.count("*").alias("ids"), F.max("length").alias("length"))
    own = sizes.join(covered, "tid", "left").select("tid", F.when(F.col("ids") > 1, F.col("length")).otherwise(F.coalesce("covered", F.lit(0))).cast("long").alias("shared_chars"))
    per_key = held.select("tid", "id").join(own.where("shared_chars > 0"), "tid").groupBy("id").agg(F.max("shared_chars").alias("shared_chars"))
    chars = records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("chars"))
    part = F.coalesce("shared_chars", F.lit(0).cast("long"))
    return chars.join(per_key, "id", "left").select("id", "chars", part.alias("shared_chars"), F.when(F.col("chars") > 0, F.round(part / F.col("chars"), 6)).otherwise(F.lit(0.0)).alias("share"))
