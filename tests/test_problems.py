"""Snapshot changes and schema drift against plain readings of their rules."""

import json
import random
from datetime import datetime, timedelta

from vellum.operators import drift, snapshots

T0 = datetime(2025, 1, 1)


def _changes(spark, rows, taken):
    df = spark.createDataFrame(rows, "snapshot_id string, document_id string, content_sha256 string, parser_version string, delivered_at timestamp_ntz, n int, key string")
    order = spark.createDataFrame(taken, "snapshot_id string, taken_at timestamp_ntz")
    return {tuple(r) for r in snapshots.snapshot_changes(df, order, "document_id", ["content_sha256", "parser_version"]).collect()}


def test_snapshot_changes_match_plain_reading(spark):
    rng = random.Random(1)
    taken = [("s10", T0), ("s2", T0 + timedelta(1)), ("s1", T0 + timedelta(2)), ("s3", T0 + timedelta(3))]
    rows = []
    for _ in range(400):
        rows.append((rng.choice(["s10", "s2", "s1", "other"]), f"d{rng.randrange(40)}", rng.choice(["a", "b", None]), rng.choice(["1", None]), T0 + timedelta(rng.randrange(10**6)), 1, "k"))
    rows += rows[:20] + [("s2", None, "a", "1", T0, 1, "k")]
    state = {}
    for s, d, h, p, at, *_ in rows:
        if d is not None and (s, d) not in state or d is not None and at > state[s, d][0]:
            state[s, d] = (at, h, p)
    names, want = [s for s, _ in taken], set()
    for before, now in zip(names, names[1:], strict=False):
        for d in {d for _, d in state}:
            a, b = state.get((before, d)), state.get((now, d))
            if (a is None) != (b is None):
                want.add((now, d, "added" if a is None else "removed"))
            elif a and a[1:] != b[1:]:
                want.add((now, d, "changed"))
    assert _changes(spark, rows, taken) == want and len({c for *_, c in want}) == 3


def test_snapshot_changes_edges(spark):
    assert _changes(spark, [], [("a", T0), ("b", T0 + timedelta(1))]) == set()
    row = ("a", "d", None, None, None, 1, "k")
    assert _changes(spark, [row], []) == set()
    assert _changes(spark, [row, row], [("a", T0), ("b", T0 + timedelta(1))]) == {("b", "d", "removed")}
    # of deliveries at one time the one with values counts; values can't run into each other
    tie = [("a", "d", "x", "1", T0, 1, "k"), ("a", "d", None, "1", T0, 1, "k"), ("b", "d", "x", "1", T0, 1, "k"), ("a", "e", "x,1:", "1", T0, 1, "k"), ("b", "e", "x", ",1:1", T0, 1, "k")]
    assert _changes(spark, tie, [("a", T0), ("b", T0 + timedelta(1))]) == {("b", "e", "changed")}


def _brute_drift(rows):
    out = set()
    feeds = {}
    for feed, no, name, payload in rows:
        if feed is not None and no is not None:
            feeds.setdefault(feed, {}).setdefault(no, []).append((name, payload))
    for files in feeds.values():
        order = sorted(files)
        flat = {}
        for no in order:
            flat[no] = [f for _, p in files[no] if p is not None and (f := drift.flatten(p)) is not None]
        types = {no: {} for no in order}
        for no in order:
            for f in flat[no]:
                for path, values in f.items():
                    types[no].setdefault(path, set()).update(drift.JSON_TYPES[type(v)] for v in values)
        for a, b in zip(order, order[1:], strict=False):
            gone, new = set(types[a]) - set(types[b]), set(types[b]) - set(types[a])

            def held(no, path, flat=flat):
                docs = {}
                for f in flat[no]:
                    if path in f and f.get("id"):
                        docs.setdefault(f["id"][0], set()).add(json.dumps(f[path] if len(f[path]) > 1 else f[path][0]))
                return docs

            renamed = set()
            for o in gone:
                for n in new:
                    x, y = held(a, o), held(b, n)
                    common = set(x) & set(y)
                    if common and all(x[d] == y[d] for d in common):
                        renamed.add((o, n))
            name = files[b][0][0]
            out |= {(name, "renamed", o, n) for o, n in renamed}
            out |= {(name, "removed", o, "") for o in gone - {o for o, _ in renamed}} | {(name, "added", "", n) for n in new - {n for _, n in renamed}}
            out |= {(name, "retyped", p, p) for p in set(types[a]) & set(types[b]) if types[a][p] != types[b][p]}
    return out


def test_drift_matches_plain_reading(spark):
    rng = random.Random(5)
    rows = []
    for feed in ("f1", "f2", "f3"):
        names = {"body": "body", "date": "date", "organ": "organs"}
        shape = "text"
        for no in range(1, 9):
            if rng.random() < 0.6:
                names[rng.choice(list(names))] = rng.choice(["body", "content", "date", "day", "organs", "issuers", "x.y"]) + rng.choice(["", "2"])
            shape = rng.choice(["text", "text", "number", "list"])
            for doc in range(6):
                if rng.random() < 0.2:
                    continue
                day = {"text": "2020-01-01", "number": 1577836800000, "list": [2020, 1, 1]}[shape]
                data = {"id": f"d{doc}", names["body"]: f"body {doc}", names["date"]: day if rng.random() > 0.1 else None, names["organ"]: [{"name": f"o{doc}"}, {"name": "p"}], "empty": {}, "flag": True}
                payload = json.dumps(data, ensure_ascii=rng.random() < 0.5)
                if rng.random() < 0.05:
                    payload = payload[:-5]
                rows.append((feed, no, f"{feed}_{no}", payload))
    rows += [("f1", 2, "f1_2", None), (None, 1, "x", "{}"), ("f2", None, "x", "{}"), ("f4", 1, "f4_1", '{"id": "a"}'), ("f4", 3, "f4_3", "not json"), rows[0], rows[0]]
    df = spark.createDataFrame([(*r, "c") for r in rows], "feed string, no int, name string, payload string, path string")
    got = {(r["file_name"], r["change"], r["old_path"], r["new_path"]) for r in drift.schema_changes(df, "feed", "no", "name", "payload", "id").collect()}
    assert got == _brute_drift(rows) and len({c for _, c, *_ in got}) == 4
    fields = drift.catalogue(df, "feed", "no", "payload").cache()
    spans = drift.lifespans(fields, drift.files_of(df, "feed", "no", "name")).collect()
    assert sum(r["files"] for r in spans) == fields.count() and len({r["type"] for r in spans}) == 4


def test_flatten_and_casts(spark):
    assert drift.flatten('{"a": {"b": [1, 2]}, "c": [{"d": "x"}, {"d": null}, {"d": "y"}], "e": null, "f": {}}') == {"a.b": [[1, 2]], "c": [[{"d": "x"}, {"d": None}, {"d": "y"}]], "c.d": ["x", "y"]}
    assert drift.flatten('{"c": [{"d": "x"}, [{"d": 1}, 2], 3], "e": []}', lists=False) == {"c.d": ["x", 1], "e": [[]]}
    assert drift.flatten("{") is None and drift.flatten('{"a": NaN}') is None and drift.flatten("3") == {}
    assert drift.spelled(1.0) == drift.spelled(1) and drift.spelled("1") != drift.spelled(1)
    payloads = ['{"a": "2020-02-03T00:00:00"}', '{"b": [2020, 2, 3]}', '{"a": 1580688000000}', '{"a": "never"}', "{", None]
    df = spark.createDataFrame([(i, "f", 1, "n", p) for i, p in enumerate(payloads)], "id int, feed string, file_no int, name string, payload string")
    table = drift.consistent_table(df, "id", "feed", "file_no", "name", "payload", {"day": (["a", "b"], "date"), "text": (["a"], "string")})
    assert {r["id"]: str(r["day"]) for r in table.collect()} == {0: "2020-02-03", 1: "2020-02-03", 2: "2020-02-03", 3: "None"}


def test_table_follows_the_renames_and_loses_no_field(spark):
    held = [
        ("f", 1, '{"id": "d", "day": "2020-02-03", "body": "x", "n": 1}'), ("f", 2, '{"id": "d", "issued": "2020-02-03", "html": {"b": "x"}, "n": 1}'),
        ("g", 1, '{"id": "e", "issued": "13/06/2023", "html": {"b": "y"}, "page": [7]}'), ("g", 2, '{"id": "e", "issuedOn": "13/06/2023", "html": {"b": "y"}, "sheet": [7]}'),
        ("g", 3, '{"id": "e", "issuedOn": "soon", "day": " ", "html": {"b": "y"}, "sheet": [7], "body": "z"}'),
    ]
    df = spark.createDataFrame([(i, feed, no, f"{feed}{no}", p) for i, (feed, no, p) in enumerate(held)], "rid int, feed string, file_no int, name string, payload string")
    columns = {"on": (["day"], "date"), "text": (["body"], "string")}
    table = drift.consistent_table(df, "rid", "feed", "file_no", "name", "payload", columns, drift.schema_changes(df, "feed", "file_no", "name", "payload", "id"))
    got = {r["rid"]: (str(r["on"]), r["text"], json.loads(r["other"]), r["uncast"]) for r in table.collect()}
    assert got == {
        0: ("2020-02-03", "x", {"id": "d", "n": 1}, None), 1: ("2020-02-03", "x", {"id": "d", "n": 1}, None),
        2: ("2023-06-13", "y", {"id": "e", "page": [7]}, None), 3: ("2023-06-13", "y", {"id": "e", "page": [7]}, None),
        4: ("None", "z", {"id": "e", "page": [7], "issuedOn": "soon", "html.b": "y"}, None),
    }
    late = drift.consistent_table(df.where("rid = 4"), "rid", "feed", "file_no", "name", "payload", {"on": (["issuedOn"], "date")}).collect()
    assert late[0]["on"] is None and json.loads(late[0]["uncast"]) == {"on": "soon"}


def test_drift_of_empty_table(spark):
    df = spark.createDataFrame([], "feed string, no int, name string, payload string")
    assert drift.schema_changes(df, "feed", "no", "name", "payload", "id").count() == 0
