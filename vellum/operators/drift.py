"""Schemas that drift between the files of a feed.

A column lifespan catalogue: a first scan of the payloads lists which paths and JSON types each file has; lag over a
feed's files gives the islands of files in which a path has a type, and the log of their beginnings and endings tells
where a path comes, goes or changes type. Only the values of paths that come or go are read, in a second scan; an ending
and a beginning with equal values are a rename. The renames of all feeds together are the alias table, and the columns
and casts of the consistent table follow from it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.session import cut

#: Pairs of old and new names that the driver holds at most.
MOST_RENAMES = 100_000
#: Fields a task counts before it hands them on.
FLUSH = 200_000
#: Types of JSON values by their Python type, in the order of their bits.
JSON_TYPES = {str: "string", int: "number", float: "number", bool: "boolean", list: "array"}
NAMES = ("array", "boolean", "number", "string")
BITS = {kind: 1 << NAMES.index(name) for kind, name in JSON_TYPES.items()}


def flatten(payload: str, lists: bool = True) -> dict[str, list] | None:
    """Values by key path; None for what isn't valid JSON.

    Keys are joined by dots. A list is a value at its path; through one that holds objects the paths of these go on as if
    it weren't there, and their values are listed in order. Nulls and objects are no values. Without lists, a list that
    holds objects is passed through only.
    """
    try:
        root = json.loads(payload, parse_constant=_no_constant)
    except (ValueError, TypeError, RecursionError):
        return None
    out: dict[str, list] = {}
    todo = [("", root, True)]
    while todo:
        path, value, own = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{path}.{k}" if path else k, v, True) for k, v in reversed(list(value.items()))]
        elif isinstance(value, list):
            inner = [x for x in value if isinstance(x, dict | list)]
            if path and own and (lists or not inner):
                out.setdefault(path, []).append(value)
            todo += [(path, x, False) for x in reversed(inner)]
        elif value is not None and path and own:
            out.setdefault(path, []).append(value)
    return out


def _no_constant(name: str) -> None:
    raise ValueError(name)


def spelled(value: object) -> str:
    """One spelling of a JSON value; numbers that are equal are spelled alike."""
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if isinstance(value, list):
        return "[" + ",".join(map(spelled, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{spelled(v)}" for k, v in sorted(value.items())) + "}"
    return json.dumps(value, ensure_ascii=False)


def _deliveries(records: DataFrame, feed: str, file_no: str, payload: str) -> DataFrame:
    return records.select(F.col(feed).cast("string").alias("feed"), F.col(file_no).cast("int").alias("file_no"), F.col(payload).alias("payload")).where("feed is not null and file_no is not null and payload is not null")


def files_of(records: DataFrame, feed: str, file_no: str, file_name: str) -> DataFrame:
    """The files of each feed in order: feed, file_no, file_name, n (from 1), files (of the feed)."""
    names = records.where(F.col(feed).isNotNull() & F.col(file_no).isNotNull()).groupBy(F.col(feed).cast("string").alias("feed"), F.col(file_no).cast("int").alias("file_no")).agg(F.max(F.col(file_name).cast("string")).alias("file_name"))
    return names.select("*", F.row_number().over(Window.partitionBy("feed").orderBy("file_no")).alias("n"), F.count("*").over(Window.partitionBy("feed")).alias("files"))


def catalogue(records: DataFrame, feed: str, file_no: str, payload: str) -> DataFrame:
    """Which fields each file has: feed, file_no, path, type (a row for each JSON type seen).

    A task hands on each field of a file once, so what is shuffled is as large as the schemas, not as the payloads.
    """

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}

        def out() -> pa.RecordBatch:
            keys = list(seen)
            columns = [*(pa.array([k[c] for k in keys], t) for c, t in enumerate((pa.string(), pa.int32(), pa.string()))), pa.array(list(seen.values()), pa.int32())]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, names=["feed", "file_no", "path", "types"])

        for batch in batches:
            for feed, no, payload in zip(*(batch.column(c).to_pylist() for c in ("feed", "file_no", "payload")), strict=True):
                for path, values in (flatten(payload) or {}).items():
                    key = feed, no, path
                    bits = seen.get(key, 0)
                    for x in values:
                        bits |= BITS[type(x)]
                    seen[key] = bits
            if len(seen) >= FLUSH:
                yield out()
        yield out()

    found = _deliveries(records, feed, file_no, payload).mapInArrow(steps, "feed string, file_no int, path string, types int")
    types = found.groupBy("feed", "file_no", "path").agg(F.bit_or("types").alias("types"))
    each = F.filter(F.array(*(F.when(F.col("types").bitwiseAND(1 << i) != 0, name) for i, name in enumerate(NAMES))), lambda x: x.isNotNull())
    return types.select("feed", "file_no", "path", F.explode(each).alias("type"))


def lifespans(fields: DataFrame, files: DataFrame) -> DataFrame:
    """Islands of consecutive files in which a field has a type: feed, path, type, first_file, last_file, files, open_end.

    first_n and last_n are the places of these files in the feed, all is how many files it has.
    """
    order = files.select("feed", "file_no", "n", F.col("files").alias("all"))
    w = Window.partitionBy("feed", "path", "type").orderBy("n")
    numbered = fields.join(order, ["feed", "file_no"]).withColumn("begins", F.when(F.lag("n").over(w) == F.col("n") - 1, 0).otherwise(1)).withColumn("island", F.sum("begins").over(w))
    spans = numbered.groupBy("feed", "path", "type", "island").agg(F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"), F.count("*").alias("files"), F.min("n").alias("first_n"), F.max("n").alias("last_n"), F.max("all").alias("all"))
    return spans.withColumn("open_end", F.col("last_n") == F.col("all")).drop("island")


def _edges(fields: DataFrame, files: DataFrame) -> DataFrame:
    """Where a field ends, begins or changes type, from the islands' log: feed, n (of the later file), path, edge."""
    spans = lifespans(fields, files)
    log = spans.where("first_n > 1").select("feed", F.col("first_n").alias("n"), "path").unionByName(spans.where("not open_end").select("feed", (F.col("last_n") + 1).alias("n"), "path")).distinct()
    held = fields.join(files.select("feed", "file_no", "n"), ["feed", "file_no"]).select("feed", "n", "path").distinct()
    now, before = held.withColumn("now", F.lit(True)), held.select("feed", (F.col("n") + 1).alias("n"), "path", F.lit(True).alias("before"))
    both = log.join(now, ["feed", "n", "path"], "left").join(before, ["feed", "n", "path"], "left")
    return both.select("feed", "n", "path", F.when(F.col("before").isNull(), "begin").when(F.col("now").isNull(), "end").otherwise("retype").alias("edge"))


def _moving_values(records: DataFrame, edges: DataFrame, files: DataFrame, feed: str, file_no: str, payload: str, doc_path: str) -> DataFrame:
    """Values of ending paths in the earlier file and of beginning ones in the later: feed, n, doc, role, path, a, b.

    a and b are two hashes of the field's values in one document of the file.
    """
    moving = edges.where("edge <> 'retype'").select("feed", "n", (F.col("n") - F.when(F.col("edge") == "end", 1).otherwise(0)).alias("at"), "path", F.when(F.col("edge") == "end", "old").otherwise("new").alias("role"))
    places = files.select("feed", "file_no", F.col("n").alias("at"))
    wanted = moving.join(places, ["feed", "at"]).groupBy("feed", "file_no").agg(F.collect_set(F.struct("path", "role", "n")).alias("wanted"))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows, hashes = [], [], []
            for i, (text, asked) in enumerate(zip(batch.column("payload").to_pylist(), batch.column("wanted").to_pylist(), strict=True)):
                fields = flatten(text)
                doc = fields.get(doc_path) if fields else None
                if not doc:
                    continue
                name = doc[0] if isinstance(doc[0], str) else spelled(doc[0])
                for x in asked:
                    if (values := fields.get(x["path"])) is not None:
                        owner.append(i)
                        rows.append((x["n"], name, x["role"], x["path"]))
                        hashes.append(blake2b((spelled(values[0]) if len(values) == 1 else spelled(values)).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            pairs = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("feed").take(pa.array(owner, pa.int64())), *(pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.string()))), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                names=["feed", "n", "doc", "role", "path", "a", "b"],
            )

    return _deliveries(records, feed, file_no, payload).join(wanted, ["feed", "file_no"]).select("feed", "payload", "wanted").mapInArrow(steps, "feed string, n int, doc string, role string, path string, a long, b long")


def schema_changes(records: DataFrame, feed: str, file_no: str, file_name: str, payload: str, doc_path: str = "data.docGUId") -> DataFrame:
    """Every change of fields from a feed's file to its next: feed, file_no, file_name, change, old_path, new_path.

    renamed: a path that ends and one that begins hold equal values in every document of both files where both have one
    (at least one). removed, added: other paths of one file only (the missing path is ''). retyped: another set of types.
    Payloads that aren't valid JSON, null feeds and file numbers are left out; repeated rows change nothing; a file none
    of whose payloads is valid has no fields. A document that comes with several payloads has all of their values.
    """
    files = files_of(records, feed, file_no, file_name)
    edges = cut(_edges(cut(catalogue(records, feed, file_no, payload)), files))
    each = _moving_values(records, edges, files, feed, file_no, payload, doc_path).distinct()
    # a document's values of a path as one value of fixed size, in whatever order they come
    held = each.groupBy("feed", "n", "doc", "role", "path").agg(F.struct(F.bit_xor("a"), F.bit_xor("b"), F.count("*")).alias("value"))
    # the paths that move between two files are few; a pair that differs once is no rename
    moves = held.groupBy("feed", "n", "doc").agg(F.collect_list(F.struct("role", "path", "value")).alias("moves"))
    side = lambda role: F.filter("moves", lambda x: x["role"] == role)
    pair = lambda o, w: F.struct(o["path"].alias("old_path"), w["path"].alias("new_path"), (o["value"] == w["value"]).alias("same"))
    pairs = moves.select("feed", "n", F.explode(F.flatten(F.transform(side("old"), lambda o: F.transform(side("new"), lambda w: pair(o, w))))).alias("x")).select("feed", "n", "x.*")
    renamed = cut(pairs.groupBy("feed", "n", "old_path", "new_path").agg(F.bool_and("same").alias("same")).where("same").select("feed", "n", "old_path", "new_path"))

    def alone(edge: str, side: str) -> DataFrame:
        known = renamed.select("feed", "n", F.col(side).alias("path")).distinct()
        return edges.where(F.col("edge") == edge).join(known, ["feed", "n", "path"], "left_anti")

    none = F.lit("")
    every = [
        renamed.select("feed", "n", F.lit("renamed").alias("change"), "old_path", "new_path"),
        alone("end", "old_path").select("feed", "n", F.lit("removed").alias("change"), F.col("path").alias("old_path"), none.alias("new_path")),
        alone("begin", "new_path").select("feed", "n", F.lit("added").alias("change"), none.alias("old_path"), F.col("path").alias("new_path")),
        edges.where("edge = 'retype'").select("feed", "n", F.lit("retyped").alias("change"), F.col("path").alias("old_path"), F.col("path").alias("new_path")),
    ]
    changes = every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])
    return changes.join(files.select("feed", "n", "file_no", "file_name"), ["feed", "n"]).select("feed", "file_no", "file_name", "change", "old_path", "new_path")


def aliases(changes: DataFrame, columns: dict[str, tuple[list[str], str]]) -> dict[str, str]:
    """The alias table: each renamed path and the path it counts as, from the renames that schema_changes found.

    Paths linked by renames, in whatever feeds, are one field; it goes by the first name of the column it belongs to, else
    by its first path in code point order. Renames seen in more files link first, and none links two columns. Names are
    part of a schema, so they are few; over MOST_RENAMES of them is an error, none is left out.
    """
    pairs = changes.where("change = 'renamed'").groupBy("old_path", "new_path").agg(F.count("*").alias("n")).limit(MOST_RENAMES + 1).collect()
    if len(pairs) > MOST_RENAMES:
        raise ValueError(f"more than {MOST_RENAMES} renames")
    field = {path: name for name, (known, _) in columns.items() for path in known}
    above: dict[str, str] = {path: known[0] for known, _ in columns.values() for path in known}

    def top(path: str) -> str:
        while above.setdefault(path, path) != path:
            path = above[path]
        return path

    for old, new, _ in sorted(pairs, key=lambda r: (-r["n"], r["old_path"], r["new_path"])):
        a, b = top(old), top(new)
        if a != b and not (a in field and b in field):
            first, second = sorted((a, b), key=lambda x: (x not in field, x))
            above[second] = first
    return {path: top(path) for path in above if top(path) != path}


def consistent_table(records: DataFrame, key: str, feed: str, file_no: str, file_name: str, payload: str, columns: dict[str, tuple[list[str], str]], changes: DataFrame | None = None) -> DataFrame:
    """One table of all valid records: key, feed, file_no, a column for each entry of columns, other, uncast.

    columns: name -> (paths known to hold it, first found wins; type: string, date, number or array); changes (of
    schema_changes) tells the further names of each, see aliases. Casts: a date comes as ISO text at any time of day, as
    day/month/year text, as milliseconds since 1970 or as [year, month, day]; text comes as text, number or a list of
    texts (joined by line ends). other is a JSON object of every path without a column, under the name it counts as, or
    its own where several of a field hold values in a record. What can't be cast is null and stands in uncast, a JSON object of column and value;
    blank text is no value. Both are null where there is nothing. Rows repeated as a whole come once.
    """
    same = aliases(changes, columns) if changes is not None else {}
    wanted: dict[str, list[tuple[str, int]]] = {}
    for name, (known, _) in columns.items():
        found = sorted(path for path, first in same.items() if first == known[0] and path not in known)
        for i, path in enumerate([*known, *found]):
            wanted.setdefault(path, []).append((name, i))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, payload in enumerate(batch.column("payload").to_pylist()):
                fields = flatten(payload, lists=False) if payload is not None else None
                if fields is None:
                    continue
                best: dict[str, tuple[int, str]] = {}
                for path in fields:
                    for name, place in wanted.get(path, ()):
                        if name not in best or place < best[name][0]:
                            best[name] = (place, path)
                used = {path for _, path in best.values()}
                other: dict[str, object] = {}
                for path in sorted(fields.keys() - used, key=lambda x: (x in same, x)):
                    name = same.get(path, path)
                    other[path if name in other or path in wanted else name] = fields[path][0] if len(fields[path]) == 1 else fields[path]
                cells = {name: _cast(fields[path], columns[name][1]) for name, (_, path) in best.items()}
                failed = {name: fields[path][0] if len(fields[path]) == 1 else fields[path] for name, (_, path) in best.items() if cells[name] is None and not _blank(fields[path])}
                rows.append((i, cells, *(json.dumps(x, ensure_ascii=False, sort_keys=True) if x else None for x in (other, failed))))
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in ("key", "feed", "file_no")), *(pa.array([r[1].get(name) for r in rows], ARROW[kind]) for name, (_, kind) in columns.items()), *(pa.array([r[n] for r in rows], pa.string()) for n in (2, 3))], names=["key", "feed", "file_no", *columns, "other", "uncast"]
            )

    source = records.select(F.col(key).alias("key"), F.col(feed).cast("string").alias("feed"), F.col(file_no).cast("int").alias("file_no"), F.col(payload).alias("payload")).distinct()
    types = {"string": "string", "date": "date", "number": "double", "array": "array<string>"}
    schema = f"key {source.schema['key'].dataType.simpleString()}, feed string, file_no int, " + "".join(f"`{name}` {types[kind]}, " for name, (_, kind) in columns.items()) + "other string, uncast string"
    return source.mapInArrow(steps, schema).withColumnRenamed("key", key)


ARROW = {"string": pa.string(), "date": pa.date32(), "number": pa.float64(), "array": pa.list_(pa.string())}


#: A date as day, month and year.
DAY_FIRST = re.compile(r"\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?!\d)")


def _blank(values: list) -> bool:
    return all(isinstance(x, str) and not x.strip() for v in values for x in (v if isinstance(v, list) else [v]))


def _cast(values: list, kind: str) -> object:
    from datetime import UTC, date, datetime

    flat = [x for v in values for x in (v if isinstance(v, list) else [v])]
    if kind == "array":
        return [x if isinstance(x, str) else spelled(x) for x in flat]
    if kind == "string":
        text = "\n".join(x if isinstance(x, str) else spelled(x) for x in flat)
        return text or None
    first = flat[0] if flat else None
    try:
        if kind == "number":
            return float(first)
        if len(flat) == 3 and all(isinstance(x, int) for x in flat):
            return date(*flat)
        if isinstance(first, int | float) and not isinstance(first, bool):
            seconds = first / 1000 if abs(first) > 10**10 else first
            return datetime.fromtimestamp(seconds, UTC).date()
        if found := DAY_FIRST.match(str(first)):
            return date(*map(int, found.groups()[::-1]))
        return date.fromisoformat(str(first).strip()[:10])
    except (TypeError, ValueError, OverflowError, OSError):
        return None
