"""Cutting oversized texts into overlapping pieces at natural boundaries.

A text is worked on in ranges (split_texts takes them from a text that stands whole in its row, split_files from a file
that is never read as a whole): each range carries a halo of its neighbours' characters, a task finds
the boundaries in it, and the boundary tables of a text's ranges are stitched by offset. Cuts are placed in zones: zone k
begins at k * pitch and is as long as the slack, where pitch + slack + overlap is the limit. The best boundary of each
zone is a cut, so two cuts are never further apart than the limit allows. Zones without a boundary are left out: cuts go
from the last boundary before them, as far apart as allowed, to the next zone with one. Ranges end at a zone with a
boundary, so that no range depends on another and a text is cut in one parallel pass. A stretch without a boundary is
cut only if it is longer than pitch + slack, and as seldom as possible. Pieces are then emitted by offset.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Part of a piece (without overlap) within which its end may be moved to a natural boundary.
SLACK = 0.4
#: Characters before and after a range that a boundary rule may look at.
HALO = 40
#: Zones worked on in one range.
ZONES_PER_RANGE = 16
#: Bytes read at a time while a line end is looked for.
CHUNK = 1 << 16

#: Boundaries from the strongest to the weakest; a cut falls at the end of the match.
BOUNDARIES = (
    ("unit", re.compile(r"(?:\r\n|\n|\r)[ \t]*(?=(?:Phần|PHẦN|Chương|CHƯƠNG|Mục|MỤC|Điều|ĐIỀU|Khoản|Điểm)\s|\d{1,3}[.)]\s|[a-zđ]\)\s)")),
    ("line", re.compile(r"\r\n|\n|\r(?!\n)")),
    ("sentence", re.compile(r"[.!?…;:][”\"’)]*[ \t]+")),
    ("clause", re.compile(r"[,)][ \t]+")),
    ("word", re.compile(r"[ \t]+")),
)

def best_cut(before: str, zone: str, after: str) -> tuple[int, str]:
    """(characters of zone before the cut, kind): the strongest boundary in a zone, of equals the last.

    Position 0 is never chosen unless the zone is empty. Without a boundary the zone's end is cut, but not between a
    letter and its accents, nor in a line end of two characters.
    """
    window, start, end = before + zone + after, len(before), len(before) + len(zone)
    for kind, rule in BOUNDARIES:
        at = max((m.end() for m in rule.finditer(window) if start < m.end() <= end), default=None)
        if at is not None and not (at < len(window) and window[at - 1] == "\r" and window[at] == "\n"):
            return at - start, kind
    at = end
    while at - 1 > start and at < len(window) and (unicodedata.category(window[at]) in ("Mn", "Cf") or window[at - 1 : at + 1] == "\r\n"):
        at -= 1
    return at - start, "none"


def last_boundary(before: str, zone: str, after: str) -> tuple[int, str] | None:
    """(characters of zone before it, kind) of the last boundary in a zone, of its kinds the strongest."""
    window, start, end = before + zone + after, len(before), len(before) + len(zone)
    best = None
    for kind, rule in BOUNDARIES:
        for m in rule.finditer(window):
            at = m.end()
            if start < at <= end and not (at < len(window) and window[at - 1 : at + 1] == "\r\n") and (best is None or at - start > best[0]):
                best = at - start, kind
    return best


def _best(part: str, offset: int, begin: int, end: int, chars: int) -> tuple[int, str]:
    """(place, kind) of the best cut after begin up to end in a text, of which part stands at offset."""
    a, b = begin - offset, min(end, chars - 1) - offset
    inner, kind = best_cut(part[max(0, a - HALO) : a], part[a:b], part[b : b + HALO])
    return begin + inner, kind


def zone_cuts(part: str, offset: int, first: int, last: int, final: bool, pitch: int, slack: int, chars: int) -> list[tuple[int, str]]:
    """Cuts of the zones first to last of a text, of which part stands at offset: (place, kind), without the text's end.

    Zones without a boundary are left out: from the cut before them to the one behind them each piece ends at the best
    boundary of the last slack within its reach, else the last boundary within it, else at its reach. The zone before
    first has a boundary, and last has one unless it is the text's final zone.
    """
    zones = [_best(part, offset, k * pitch, k * pitch + slack, chars) for k in range(first, last + 1)]
    at = _best(part, offset, (first - 1) * pitch, (first - 1) * pitch + slack, chars)[0] if first > 1 else 0
    cuts = []
    for place, kind in [*zones, *([(chars, "end")] if final else [])]:
        if kind == "none":
            continue
        while place - at > pitch + slack:
            found = _best(part, offset, at + pitch, at + pitch + slack, chars)
            a, b = at - offset, at + pitch - offset
            if found[1] == "none" and (near := last_boundary(part[max(0, a - HALO) : a], part[a:b], part[b : b + HALO])):
                found = at + near[0], near[1]
            at = found[0]
            cuts.append(found)
        at = place
        if kind != "end":
            cuts.append((place, kind))
    return cuts


def split_texts(items: DataFrame, limits: DataFrame, kind: str, key: str, text: str) -> DataFrame:
    """Pieces of the texts longer than their kind's limit.

    items: any columns, of which kind, key and text are used; limits: item_kind, max_chars, overlap_chars (one row a
    kind, few rows). Result: item_kind, item_key, piece_no (from 1), pieces, begin, end (code points, 0-based, end
    exclusive), cut (what the piece ends at; 'end' for the last), text. Every piece has at most max_chars characters,
    repeats exactly overlap_chars of the one before (or all of it where that is shorter), and the pieces without their
    overlaps make up the text. Texts within the limit, null keys and null texts give no rows; a key that comes with the
    same text again counts once, with another text it is cut for each. Kinds without a limit are left alone; the
    overlap is held below half the limit.
    """
    # limits is a parameter table with one row per kind
    rules = F.broadcast(
        limits.where("item_kind is not null and max_chars > 1").groupBy("item_kind").agg(F.min("max_chars").alias("max_chars"), F.min(F.coalesce("overlap_chars", F.lit(0))).alias("overlap"))
        .withColumn("overlap", F.greatest(F.lit(0), F.least("overlap", F.expr("cast((max_chars - 1) div 2 as int)"))))
        .withColumn("slack", F.greatest(F.lit(1), F.floor((F.col("max_chars") - F.col("overlap")) * SLACK)).cast("int"))
        .withColumn("pitch", (F.col("max_chars") - F.col("overlap") - F.col("slack")).cast("int"))
    )
    source = items.select(F.col(kind).alias("item_kind"), F.col(key).cast("string").alias("item_key"), F.col(text).alias("text")).where("item_key is not null")
    # length is checked before anything moves: only oversized texts are shuffled
    large = source.join(rules, "item_kind").withColumn("chars", F.length("text")).where("chars > max_chars")
    large = large.withColumn("version", F.xxhash64("text")).dropDuplicates(["item_kind", "item_key", "version"])
    ranges = _ranges(large)
    # the cut tables of a text's ranges are stitched: numbers by a running sum, the first piece from the cut before
    order = Window.partitionBy(*ITEM).orderBy("range")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stitched = ranges.select(
        "*", F.coalesce(F.sum(F.size("cuts")).over(before), F.lit(0)).alias("done"), F.sum(F.size("cuts")).over(whole).cast("int").alias("pieces"),
        F.coalesce(F.last(F.try_element_at("cuts", F.lit(-1))["at"], ignorenulls=True).over(before), F.lit(0)).alias("last_at"),
    )
    each = stitched.select(
        *ITEM, "pieces", "done", "overlap", "offset", "part", F.col("last_at"), "cuts", F.posexplode("cuts").alias("pos", "c"),
    ).withColumn("from_at", F.when(F.col("pos") == 0, F.col("last_at")).otherwise(F.col("cuts")[F.col("pos") - 1]["at"]))
    placed = each.select("item_kind", "item_key", (F.col("done") + F.col("pos") + 1).cast("int").alias("piece_no"), "pieces", F.greatest(F.lit(0), F.col("from_at") - F.col("overlap")).alias("begin"), F.col("c.at").alias("end"), F.col("c.cut").alias("cut"), "part", "offset")
    # a piece lies whole in the range that its end was found in
    return placed.select("item_kind", "item_key", "piece_no", "pieces", "begin", "end", "cut", F.expr("substring(part, begin - offset + 1, end - begin)").alias("text"))


ITEM = ("item_kind", "item_key", "version")


def _ranges(large: DataFrame) -> DataFrame:
    """Texts as ranges of ZONES_PER_RANGE zones or more, each with its cuts and the characters its pieces and boundary rules need.

    Zone k (from 1) is (k * pitch, k * pitch + slack]; a text has as many as keep its last piece under the limit. A
    range goes on until its last zone has a boundary. Columns: ITEM, range, overlap, offset, part, cuts (at, cut).
    """

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows, parts, cuts = [], [], [], []
            for i, (pitch, slack, overlap, chars, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pitch", "slack", "overlap", "chars", "text")), strict=True)):
                zones, n, last = _zones(chars, pitch, slack), 0, 0
                while last < zones:
                    first, last = last + 1, min(zones, last + ZONES_PER_RANGE)
                    while last < zones and _best(text, 0, last * pitch, last * pitch + slack, chars)[1] == "none":
                        last += 1
                    offset, final = max(0, (first - 1) * pitch - overlap - HALO), last == zones
                    part = text[offset:] if final else text[offset : last * pitch + slack + HALO]
                    owner.append(i)
                    rows.append((n, offset))
                    parts.append(part)
                    cuts.append([{"at": at, "cut": kind} for at, kind in [*zone_cuts(part, offset, first, last, final, pitch, slack, chars), *([(chars, "end")] if final else [])]])
                    n += 1
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in (*ITEM, "overlap")), *(pa.array([r[c] for r in rows], pa.int32()) for c in range(2)), pa.array(parts, pa.string()), pa.array(cuts, pa.list_(pa.struct([("at", pa.int32()), ("cut", pa.string())])))],
                names=[*ITEM, "overlap", "range", "offset", "part", "cuts"],
            )

    source = large.select(*ITEM, "pitch", "slack", "overlap", "chars", "text")
    return source.mapInArrow(steps, "item_kind string, item_key string, version long, overlap int, range int, offset int, part string, cuts array<struct<at: int, cut: string>>")


def _zones(chars: int, pitch: int, slack: int) -> int:
    return max(1, -(-(chars - pitch - slack) // pitch))


def split_files(spark: SparkSession, folder: str, max_chars: int, overlap_chars: int, range_bytes: int = 32 << 20) -> DataFrame:
    """Pieces of the UTF-8 text files in a folder, each too large for one task: path, begin, end (bytes), cut, text.

    No file is loaded whole. A task looks for the first line end in its byte range; these boundaries are stitched to
    stretches that begin and end at a line, and a task cuts a stretch by the rules of split_texts, reading what it repeats
    of the stretch before as a halo. A range without a line end belongs to the stretch before it. Bytes that aren't UTF-8
    come out as replacement characters. Empty files give no rows. The folder may be on any file system that pyarrow
    knows (file, hdfs, s3, gs) and that all executors see.
    """
    overlap = min(max(0, overlap_chars), (max_chars - 1) // 2)
    slack = max(1, int((max_chars - overlap) * SLACK))
    pitch = max_chars - overlap - slack
    files, root = FileSystem.from_uri(folder)
    held = [(x.path, x.size) for x in files.get_file_info(FileSelector(root, recursive=True)) if x.is_file and x.size and not x.base_name.startswith((".", "_"))]
    rows = [(path, size, start) for path, size in held for start in range(0, size, range_bytes)]
    if not rows:
        return spark.createDataFrame([], "path string, begin long, end long, cut string, text string")

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = FileSystem.from_uri(folder)[0]
        for batch in batches:
            out = []
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start")), strict=True):
                with files.open_input_file(path) as f:
                    at, end = start, min(size, start + range_bytes)
                    while start and at < end:
                        f.seek(at)
                        part = f.read(min(CHUNK, end - at))
                        if (found := part.find(b"\n")) >= 0:
                            at += found + 1
                            break
                        at += len(part)
                if at < end or not start:
                    out.append((path, size, at))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "size", "begin"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = FileSystem.from_uri(folder)[0]
        for batch in batches:
            for path, size, begin, end in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "begin", "end")), strict=True):
                halo = min(begin, 4 * overlap)
                with files.open_input_file(path) as f:
                    f.seek(begin - halo)
                    data = f.read(end - begin + halo)
                text, before = data[halo:].decode("utf-8", "surrogateescape"), data[:halo].decode("utf-8", "surrogateescape")
                before = before[max(0, len(before) - overlap) :]
                chars, out, at = len(text), [], 0
                cuts = zone_cuts(text, 0, 1, _zones(chars, pitch, slack), True, pitch, slack, chars) if chars > pitch + slack else []
                place = begin
                for cut, kind in [*cuts, (chars, "end" if end == size else "line")]:
                    piece = (before + text[:cut])[-(cut - at + overlap) :] if at < overlap else text[at - overlap : cut]
                    stop = place + len(text[at:cut].encode("utf-8", "surrogateescape"))
                    raw = piece.encode("utf-8", "surrogateescape")
                    out.append((path, stop - len(raw), stop, kind, raw.decode("utf-8", "replace")))
                    at, place = cut, stop
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["path", "begin", "end", "cut", "text"])

    tasks = min(len(rows), 4 * spark.sparkContext.defaultParallelism)
    jobs = spark.createDataFrame(rows, "path string, size long, start long").repartition(tasks, "path", "start")
    starts = jobs.mapInArrow(boundaries, "path string, size long, begin long")
    stretches = starts.withColumn("end", F.coalesce(F.lead("begin").over(Window.partitionBy("path").orderBy("begin")), F.col("size")))
    # stretches of one file are spread over all tasks
    return stretches.repartition(tasks, "path", "begin").mapInArrow(read, "path string, begin long, end long, cut string, text string")
