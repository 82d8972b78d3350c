"""Retrieval, evaluation, graph, integrity, ingest and commands on small tables."""

import json
import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from vellum import cli
from vellum.operators import dense, evaluation, graph, integrity, lexical
from vellum.plans import ingest, queries
from vellum.sources import artifacts, portal
from vellum.streaming import raw as streaming

UNITS = [
    ("s", "1/2024/X::article::3", "1/2024/X", "article", "3", "Tên", "Tên\nxe máy dừng", None, ["1/2024/X::article::3"]),
    ("s", "1/2024/X::article::3::clause::1", "1/2024/X", "clause", "1", None, "xe tải dừng đỗ xe", "1/2024/X::article::3", ["1/2024/X::article::3", "1/2024/X::article::3::clause::1"]),
    ("s", "1/2024/X::article::3::clause::1::point::đ", "1/2024/X", "point", "đ", None, "phạt tiền", "1/2024/X::article::3::clause::1", ["1/2024/X::article::3", "1/2024/X::article::3::clause::1", "1/2024/X::article::3::clause::1::point::đ"]),
    ("s", "1/2024/X::article::3::point::d", "1/2024/X", "point", "d", None, "phạt xe", "1/2024/X::article::3", ["1/2024/X::article::3", "1/2024/X::article::3::point::d"]),
    ("s", "11/2024/X::article::3", "11/2024/X", "article", "3", None, "", None, ["11/2024/X::article::3"]),
]
UNIT_SCHEMA = "snapshot_id string, unit_id string, document_id string, unit_type string, number string, title string, text string, parent_id string, path array<string>"
DOC_SCHEMA = """snapshot_id string, document_id string, portal_document_guid string, title string, portal_document_type string, source_effect_status string, fields array<string>, majors array<string>, issuing_organs array<string>,
    signers array<struct<name:string,job_title:string>>, status string, source_url string, content_url string, content_sha256 string, effective_from date, effective_to date, normalizer_version string, parser_version string, artifact_version string"""


def _doc(key, **other):
    base = dict(snapshot_id="s", document_id=key, portal_document_guid="g" + key, title="Luật " + key, portal_document_type="Luật", source_effect_status=None, fields=["a", "b"], majors=["b"], issuing_organs=["o", "o"], signers=[("n", "x"), ("n", "y")], status="current",
                source_url="https://x/" + key, content_url="https://c/" + key, content_sha256="0" * 64, effective_from=date(2024, 1, 1), effective_to=None, normalizer_version="1", parser_version="2", artifact_version="2")
    return tuple((base | other).values())


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(UNITS, UNIT_SCHEMA).cache()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([_doc("1/2024/X"), _doc("11/2024/X", fields=None, majors=[], issuing_organs=None, signers=None, portal_document_type=None)], DOC_SCHEMA).cache()


def _asked(spark, **texts):
    return lexical.normalized_queries(spark.createDataFrame(list(texts.items()), "id string, text string"), "id", "text")


def test_exact_locators(spark, units, documents):
    asked = _asked(spark, a="Điều 3 của 1/2024/X", b="khoản 1 Điều 3, 1/2024/x", c="điểm đ khoản 1 điều 3 1/2024/X", d="điểm d khoản 9 điều 3 1/2024/X", e="điểm đ điều 3 văn bản 1/2024/X", f="điều 3 11/2024/X", g="điều 3", h="điều 99 1/2024/X")
    got = {}
    for r in lexical.exact_units(asked, units, documents).collect():
        got.setdefault(r["query_id"], []).append(r["unit_id"].removeprefix("1/2024/X::article::3"))
    assert got == {"a": [""], "b": ["::clause::1"], "c": ["::clause::1::point::đ"], "d": ["::point::d"], "e": [""], "f": ["11/2024/X::article::3"]}


def test_queries_are_bounded(spark):
    asked = _asked(spark, a="  a   b\t", b="   ", c="x" * 1001, d=None)
    assert [tuple(r) for r in asked.collect()] == [("a", "a b")]


def test_bm25_by_hand(spark, units, documents):
    index = lexical.postings(units, "unit_id", "text")
    got = {r["unit_id"]: r["lexical_score"] for r in lexical.bm25_topk(_asked(spark, q="xe xe Dừng"), index, 10).collect()}
    sizes = {u[1]: len(u[6].split()) for u in UNITS}
    mean = sum(sizes.values()) / 5
    idf = lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    want = {}
    for u in UNITS:
        words = u[6].lower().split()
        s = sum(idf(sum(t in v[6].lower().split() for v in UNITS)) * words.count(t) * 2.2 / (words.count(t) + 1.2 * (0.25 + 0.75 * sizes[u[1]] / mean)) for t in ("xe", "dừng") if t in words)
        if s:
            want[u[1]] = round(s, 6)
    assert got == pytest.approx(want, abs=2e-6)
    assert tuple(lexical.index_stats(index).first()) == (5, sum(sizes.values()), mean)
    assert lexical.bm25_topk(_asked(spark, q="không có"), index).count() == 0
    assert lexical.bm25_topk(_asked(spark, q="xe"), lexical.postings(units.where("false"), "unit_id", "text")).count() == 0
    with pytest.raises(ValueError, match="between"):
        lexical.bm25_topk(_asked(spark, q="xe"), index, 0)


def _shuffled_rows(df):
    """Rows written by each exchange of a plan that has run."""
    plan, out = df._jdf.queryExecution().executedPlan(), []
    df.collect()
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "Exchange":
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        for part in ("executedPlan", "plan"):
            if hasattr(node, part) and ("QueryStage" in name or name == "AdaptiveSparkPlan") and part == ("executedPlan" if name == "AdaptiveSparkPlan" else "plan"):
                todo.append(getattr(node, part)())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_topk_is_taken_in_the_tasks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"u{i:04}", f"d{i % 7}", " ".join(rng.choice("abcdefghij") for _ in range(12))) for i in range(600)]
    held = spark.createDataFrame(rows, "unit_id string, document_id string, text string").repartition(5)
    asked = _asked(spark, q1="a b c", q2="d e", q3="f g h")
    index = lexical.postings(held, "unit_id", "text")
    found = lexical.bm25_topk(asked, index, 4)
    assert min(_shuffled_rows(found)) <= 4 * 3 * 5  # k rows a query and task, of 600 units that hold a term
    whole = sorted(map(tuple, found.collect()))
    assert len(whole) == 12
    scope = spark.createDataFrame([("q1", "d1"), ("q1", "d2"), ("q2", "none")], "query_id string, document_id string")
    scoped = {(r["query_id"], r["unit_id"]) for r in lexical.bm25_topk(asked, index, 150, scope).collect()}
    owner = {u: d for u, d, _ in rows}
    assert {q for q, _ in scoped} == {"q1", "q3"} and {owner[u] for q, u in scoped if q == "q1"} == {"d1", "d2"} and sum(q == "q3" for q, _ in scoped) == 150
    vectors = spark.createDataFrame([(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in [*range(300), *range(40)]], "vec_id int, v array<double>").repartition(5)
    near = dense.cosine_topk(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "v", 4)
    best = sorted(map(tuple, near.collect()))
    by: dict = {}
    for i, v in map(tuple, vectors.collect()):
        by.setdefault(i, []).append(v)
    unit = {i: [[x / math.hypot(*v) for x in v] for v in vs if any(v)] for i, vs in by.items()}
    first = {tuple(r)[0]: tuple(r)[1] for r in vectors.where("vec_id % 20 = 0").dropDuplicates(["vec_id"]).collect()}
    want = []
    for q, v in first.items():
        if not any(v) or len(by[q]) > 1:
            continue
        own = [x / math.hypot(*v) for x in v]
        scores = sorted((-max(round(sum(a * b for a, b in zip(own, w, strict=True)), 6) for w in ws), i) for i, ws in unit.items() if ws and i != q)
        want += [(q, i, -s, n) for n, (s, i) in enumerate(scores[:4], 1)]
    assert [r for r in best if len(by[r[0]]) == 1] == sorted(want)
    monkeypatch.setattr(lexical, "QUERY_TERMS", 2)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 3)
    assert sorted(map(tuple, lexical.bm25_topk(asked, index, 4).collect())) == whole
    once = vectors.where("vec_id >= 40")
    assert sorted(map(tuple, dense.cosine_topk(once.where("vec_id % 20 = 0"), vectors, "vec_id", "v", 4).collect())) == [r for r in best if r[0] >= 40]


def test_ranking_is_whole_and_moves_only_the_best(spark, monkeypatch):
    """Blocks of units, common and rare terms, ties over blocks and stored postings against brute force; only k rows a query and task move."""
    monkeypatch.setattr(lexical, "BLOCK", 40)
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 15))) + (f" rare{i % 90}" if i % 3 == 0 else "") for i in range(500)] + ["a b same"] * 60
    rows = [(f"u{i * 7919 % 1000:03}x{i}", f"d{i % 5}", t) for i, t in enumerate(texts)]
    held = spark.createDataFrame(rows, "unit_id string, document_id string, text string").repartition(3)
    asked = _asked(spark, q1="a b same", q2="c rare3 d", q3="e", q4="rare6 rare9 h a", q5="none")
    found = lexical.bm25_topk(asked, lexical.bags(held, "unit_id", "text"), 7)
    assert max(_shuffled_rows(found)) <= 7 * 5 * 4
    words = {u: t.split() for u, _, t in rows}
    mean = round(sum(map(len, words.values())) / len(words), 6)
    df = {t: sum(t in w for w in words.values()) for t in {t for w in words.values() for t in w}}
    idf = {t: math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    want = []
    for q, text in (("q1", "a b same"), ("q2", "c rare3 d"), ("q3", "e"), ("q4", "rare6 rare9 h a")):
        scores = {u: sum(idf[t] * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in text.split() if t in w) for u, w in words.items()}
        want += [(q, u, n) for n, (u, _) in enumerate(sorted(((u, round(x, 6)) for u, x in scores.items() if x), key=lambda x: (-x[1], x[0]))[:7], 1)]
    assert sorted((r["query_id"], r["unit_id"], r["lexical_rank"]) for r in found.collect()) == sorted(want)
    same = _asked(spark, q1="a b same", q8="Same b a b", q9="same b a")
    bags = lexical.bags(held, "unit_id", "text")
    assert lexical._weights(same, lexical._blocks(bags), None).count() == 1  # the same words are searched once
    alike = lexical.bm25_topk(same, bags, 7)
    assert sorted((r["query_id"], r["unit_id"], r["lexical_rank"]) for r in alike.collect()) == sorted((q, u, n) for q in ("q1", "q8", "q9") for p, u, n in want if p == "q1")
    stored = lexical.bm25_topk(asked, lexical.postings(held, "unit_id", "text"), 7)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, found.collect()))


def test_scored_ranking_reads_the_units_once(spark):
    """The index has the documents of its units, so nothing beside it reads the unit table again."""
    d = "/root/testdata/sf0.001"
    assert not [x for x in queries.eval_lexical(spark, d).inputFiles() if "legal_units" in x]
    found = queries._found(spark, d).select("unit_id", "document_id").distinct()
    assert found.count() and found.subtract(spark.read.parquet(f"{d}/legal_units.parquet").select("unit_id", "document_id")).count() == 0


def test_exact_hits_come_first(spark, units, documents):
    found = lexical.search(_asked(spark, q="phạt xe theo khoản 1 điều 3 1/2024/X"), units, documents, 3).orderBy("rank").collect()
    assert found[0]["unit_id"].endswith("clause::1") and found[0]["exact_rank"] == 1 and [r["rank"] for r in found] == [1, 2, 3] and found[1]["exact_rank"] is None


def test_dense(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0]), (8, [float("nan"), 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id int, v array<double>")
    got = dense.cosine_topk(df.where("vec_id in (1, 5)"), df, "vec_id", "v", 2).orderBy("dense_rank").collect()
    assert [(r["query_id"], r["vec_id"], r["dense_score"]) for r in got] == [(1, 2, 1.0), (1, 4, 0.707107)]
    assert {r["vec_id"] for r in df.where(dense.valid_vector(F.col("v"), 2)).collect()} == {1, 2, 3, 4, 6, None}
    encoded = dense.encode(spark.createDataFrame([("a", "xx"), ("b", None)], "id string, t string"), "id", "t", lambda: lambda texts: [[3.0, 4.0] if t else [0.0, 0.0] for t in texts])
    assert {r["id"]: r["vector"] for r in encoded.collect()} == {"a": [0.6, 0.8], "b": [0.0, 0.0]}


def test_embedding_texts(units, documents):
    got = {r["unit_id"]: r["text"] for r in dense.embedding_texts(units, documents).collect()}
    assert got["1/2024/X::article::3::clause::1"] == "Văn bản: Luật 1/2024/X\nVị trí: Điều 3 > Khoản 1\nxe tải dừng đỗ xe" and len(got) == 5


def test_metrics_by_hand(spark):
    questions = spark.createDataFrame([("q1", ["u1"], ["d"]), ("q2", ["u2", "u3"], ["d"]), ("q3", ["u4"], ["d"]), ("q4", [], ["d"]), ("q5", None, None)], "question_id string, gold_unit_ids array<string>, gold_document_ids array<string>")
    ranking = spark.createDataFrame([("q1", "u1", "d", 1), ("q2", "u2", "d", 1), ("q2", "x", "e", 2), ("q3", "x", "e", 1)], "query_id string, unit_id string, document_id string, rank int")
    m = evaluation.evaluation_metrics(evaluation.evaluation_cases(questions, ranking)).first()
    assert (m["questions"], m["unit_recall_1"], round(m["mrr_10"], 6), m["full_hit"], m["partial_hit"], m["miss"]) == (3, 0.5, 0.666667, 1, 1, 1)
    assert {r["question_id"]: r["ndcg"] for r in evaluation.ndcg(questions, ranking).collect()} == {"q1": 1.0, "q2": 0.613147, "q3": 0.0}
    fused = evaluation.reciprocal_rank_fusion([ranking, ranking.where("unit_id = 'x'")]).where("query_id = 'q2'").orderBy("rank").collect()
    assert [r["unit_id"] for r in fused] == ["x", "u2"]


def test_graph_reconciles(spark, units, documents):
    relation = "relation_id string, relation_type string, snapshot_id string, source struct<document_id:string,unit_id:string>, target struct<document_id:string,unit_id:string>"
    relations = spark.createDataFrame([("r1", "AMENDS", "s", ("1/2024/X", None), ("11/2024/X", "11/2024/X::article::3")), ("r2", "AMENDS", "s", ("1/2024/X", "none"), ("11/2024/X", None))], relation)
    nodes, edges = graph.nodes(documents, units), graph.edges(documents, units, relations)
    got = {(r["kind"], r["name"]): (r["expected"], r["actual"]) for r in graph.reconcile(graph.expected_counts(documents, units, relations), graph.observed_counts(nodes, edges)).collect()}
    assert got["edge", "SIGNED_BY"] == (1, 1) and got["edge", "IN_FIELD"] == (2, 2) and got["edge", "AMENDS"] == (2, 1) and got["node", "Point"] == (2, 2) and got["edge", "IN_SNAPSHOT"] == (7, 7) and len(got) == 26
    assert edges.where("type = 'IN_FIELD' and dst = 'b'").first()["extra"] == "fields,majors"
    none = graph.reconcile(graph.expected_counts(documents.where("false"), units.where("false"), relations.where("false")), graph.observed_counts(nodes.where("false"), edges.where("false")))
    assert {(r["expected"], r["actual"]) for r in none.collect()} == {(0, 0)}


def test_relation_and_gold_violations(spark, units, documents):
    schema = "relation_id string, snapshot_id string, relation_type string, review_status string, source_url string, raw_sha256 string, evidence_unit_id string, source struct<document_id:string,unit_id:string>, target struct<document_id:string,unit_id:string>"
    good = ("r0", "s", "AMENDS", "approved", "https://x/1/2024/X", "0" * 64, "1/2024/X::article::3", ("1/2024/X", None), ("11/2024/X", "11/2024/X::article::3"))
    alter = lambda key, **x: tuple((dict(zip("abcdefghi", good, strict=True)) | {"a": key} | x).values())
    rows = [good, good, alter("r1", f="1" * 64), alter("r2", h=("1/2024/X", "11/2024/X::article::3")), alter("r3", i=("1/2024/X", None)), alter("r4", h=("none", None)), alter("r5", g=None, d=None), alter("r6", e="http://x"), alter("r6")]
    got = {tuple(r) for r in integrity.relation_violations(spark.createDataFrame(rows, schema), documents, units).collect()}
    assert got == {("r1", "HASH"), ("r2", "SOURCE_UNIT"), ("r3", "NOT_CROSS_DOCUMENT"), ("r4", "UNKNOWN_DOCUMENT"), ("r5", "EVIDENCE"), ("r5", "NOT_APPROVED"), ("r6", "URL"), ("r6", "NOT_HTTPS"), ("r6", "DUPLICATE")}
    gold = [("q0", "x", ["1/2024/X"], ["1/2024/X::article::3"]), ("q1", " ", ["1/2024/X"], []), ("q2", "x", ["none"], ["none::1"]), ("q3", "x", ["1/2024/X"], ["11/2024/X::article::3"]), ("q4", None, None, None)]
    got = {tuple(r) for r in integrity.gold_violations(spark.createDataFrame(gold, "question_id string, question string, gold_document_ids array<string>, gold_unit_ids array<string>"), documents, units).collect()}
    assert got == {("q1", "BLANK"), ("q1", "NO_UNITS"), ("q2", "UNKNOWN_DOCUMENT"), ("q2", "UNKNOWN_UNIT"), ("q3", "UNIT_OF_OTHER_DOCUMENT"), ("q4", "BLANK"), ("q4", "NO_DOCUMENTS"), ("q4", "NO_UNITS"), ("q4", "REPEATED_ID")}
    with pytest.raises(integrity.IntegrityError):
        integrity.require_empty(documents, "x")


PAYLOAD = {"success": True, "tabName": "noidung", "data": {"docGUId": "g1", "docIdentity": "1/2024/NĐ-CP", "docName": "Tên  luật", "docContent": "<p>Điều 1. Một</p><p>a) hai Tp.</p>", "issueDate": "2024-12-26T00:00:00", "effectDate": "", "effectStatus": {"effectStatusName": "Còn hiệu lực"}, "fields": [{"fieldName": "a"}, {"fieldName": "a"}], "organs": [{"organName": "o"}], "signers": [{"signerName": "n", "jobTitleName": ""}], "more": 1}}


def _with(**data):
    return json.dumps(PAYLOAD | {"data": PAYLOAD["data"] | data})


def test_ingest(spark, tmp_path):
    catalog = {"snapshot_id": "s", "sources": [{"document_guid": f"g{i}", "expected_document_id": f"{i}/2024/NĐ-CP", "expected_title": "Tên luật", "expected_public_url": "https://x", "review_status": "approved", "reviewed_text_replacements": [{"find": "Tp.", "replace": "TP", "expected_count": 1 if i != 5 else 2, "evidence_url": "https://e", "reason": "r"}]} for i in range(1, 8)]}
    (tmp_path / "catalog.json").write_text(json.dumps(catalog))
    payloads = [_with(), _with(docGUId="g9"), _with(docGUId="g3"), _with(docGUId="g4", docIdentity="4/2024/NĐ-CP", docName="khác"), _with(docGUId="g5", docIdentity="5/2024/NĐ-CP"), _with(docGUId="g6", docIdentity="6/2024/NĐ-CP", docContent="<p>Tp. không có</p>"), _with(issueDate="2024-12-26T10:00:00"), "{", None, json.dumps({"success": False}), _with(docName=" ")]
    raw = spark.createDataFrame([(i, p, "2025-01-01T00:00:00+00:00") for i, p in enumerate(payloads)], "record_id int, payload string, retrieved_at string")
    source = portal.read_catalog(spark, str(tmp_path / "catalog.json"))
    done = ingest.ingest(raw, source)
    assert {tuple(r) for r in done.quarantine.collect()} == {(1, "CATALOG"), (2, "IDENTITY"), (3, "TITLE"), (4, "CORRECTION"), (5, "HIERARCHY"), *((i, "SCHEMA") for i in range(6, 11))}
    assert [(r["unit_id"], r["text"], r["parent_id"]) for r in done.units.orderBy("unit_id").collect()] == [("1/2024/NĐ-CP::article::1", "Một", None), ("1/2024/NĐ-CP::article::1::point::a", "hai TP", "1/2024/NĐ-CP::article::1")]
    d = done.documents.first()
    assert (d["document_type"], d["status"], d["issuer"], d["fields"], d["issued_date"], d["effective_from"], d["signers"][0]["job_title"]) == ("decree", "current", "o", ["a"], date(2024, 12, 26), None, None)
    assert ingest.catalog_violations(source).count() == 0


def test_write_once_and_upsert(spark, tmp_path):
    t = datetime(2025, 1, 1)
    raw = spark.createDataFrame([("a", t.replace(day=2)), ("a", t), ("b", t), (None, t)], "payload string, at timestamp_ntz")
    receipts = artifacts.first_receipts(raw, "payload", "at")
    assert receipts.count() == 2 and receipts.where("deliveries = 2").first()["retrieved_at"] == t
    assert artifacts.new_contents(raw, receipts.where("deliveries = 2"), "payload").collect()[0]["payload"] == "b"
    old, new = spark.createDataFrame([("k", 1), ("l", 1), (None, 0)], "k string, v int"), spark.createDataFrame([("k", 2), ("m", 2)], "k string, v int")
    assert {tuple(r) for r in artifacts.upsert(old, new, "k").collect()} == {("k", 2), ("l", 1), ("m", 2), (None, 0)}
    assert [r["k"] for r in artifacts.collisions(new, old, "k", "v").collect()] == ["k"]
    for snapshot, v in (("s1", 1), ("s2", 2), ("s1", 3)):
        artifacts.write_snapshot(spark.createDataFrame([(snapshot, v)], "snapshot_id string, v int"), str(tmp_path / "t"))
    assert artifacts.read_snapshot(spark, str(tmp_path / "t"), "s1").first()["v"] == 3 and spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_stream_stores_contents_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate((["a", "b", "a"], ["b", "c"])):
        (tmp_path / f"in/{i}.json").write_text("".join(json.dumps({"record_id": n, "feed": "f", "payload": p, "delivered_at": "2025-01-01T00:00:00"}) + "\n" for n, p in enumerate(rows)))
        streaming.store_new(streaming.read_deliveries(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["payload"] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == ["a", "b", "c"]


def letters():
    return lambda texts: [[1.0 + len(t), 2.0] for t in texts]


def test_write_once_and_readers(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v string")
    artifacts.write_once(frame(("a", "1"), ("a", "1")), path, ["k"], "v")
    artifacts.write_once(frame(("a", "1"), ("b", None)), path, ["k"], "v")
    assert sorted(map(str, spark.read.parquet(path).collect())) == ["Row(k='a', v='1')", "Row(k='b', v=None)"]
    for wrong in (frame(("a", "2"), ("c", "3")), frame(("c", "1"), ("c", "2"))):
        with pytest.raises(artifacts.WriteOnceError):
            artifacts.write_once(wrong, path, ["k"], "v")
    assert spark.read.parquet(path).count() == 2
    artifacts.store_normalized(spark.createDataFrame([("h", "1", "c", "x")], "content_sha256 string, normalizer_version string, corrections_sha256 string, text string"), str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).first()["text"] == "x\n"
    (tmp_path / "r.json").write_text(json.dumps({"artifact_version": "1", "snapshot_id": "s", "relations": [{"relation_id": "r1", "source": {"document_id": "d"}, "reviewed_at": "2025-01-02"}]}))
    (tmp_path / "g.json").write_text(json.dumps({"artifact_version": "1", "snapshot_id": "s", "questions": [{"question_id": "q1", "gold_unit_ids": ["u"]}, {"question_id": "q2"}]}))
    (tmp_path / "bad.json").write_text('{"artifact_version": ')
    relation = artifacts.read_relations(spark, str(tmp_path / "r.json")).first()
    assert (relation["relation_id"], relation["source"]["document_id"], relation["reviewed_at"], relation["note"]) == ("r1", "d", date(2025, 1, 2), None)
    assert [r["question_id"] for r in artifacts.read_gold(spark, str(tmp_path / "g.json")).collect()] == ["q1", "q2"]
    with pytest.raises(Exception, match=r"(?i)malformed|FAILFAST"):
        artifacts.read_gold(spark, str(tmp_path / "bad.json")).collect()


def test_catalog_lookup(spark, tmp_path):
    source = {"document_guid": "g 1/&", "expected_document_id": "1/2024/X", "reviewed_text_replacements": [{"find": "a", "replace": "b", "expected_count": 1}] * 2}
    (tmp_path / "c.json").write_text(json.dumps({"snapshot_id": "s", "sources": [source, {"document_guid": "g2", "expected_document_id": "2/2024/X"}]}))
    catalog = portal.read_catalog(spark, str(tmp_path / "c.json"))
    assert portal.select_source(catalog, "1/2024/X").first()["document_guid"] == "g 1/&" and tuple(portal.correction_count(catalog).first()) == (2, 2)
    with pytest.raises(LookupError):
        portal.select_source(catalog, "3/2024/X")
    assert portal.detail_url("g 1/&", "https://x/d") == "https://x/d?docGUId=g%201%2F%26&tabName=noidung"
    with pytest.raises(ValueError, match="https"):
        portal.fetch_raw("http://x")


def test_snapshot_sides(spark):
    import hashlib

    h = {x: hashlib.sha256(x.encode()).hexdigest() for x in "abc"}
    entry = lambda d, x, path="parsed/x.json": (d, h.get(x, x), "g", "1", "2", "2", path)
    manifest = spark.createDataFrame([entry("ok", "a"), entry("raw", "c"), entry("bytes", "b", "../x"), entry("none", None), entry("extra", "a", "/x")], "document_id string, content_sha256 string, portal_document_guid string, normalizer_version string, parser_version string, artifact_version string, parsed_path string")
    documents = manifest.where("document_id <> 'extra'").drop("parsed_path")
    raw = spark.createDataFrame([(h["a"].upper(), "a"), (h["b"], "x")], "content_sha256 string, payload string")
    receipts = spark.createDataFrame([(h["a"], "2025-01-01T00:00:00+07:00"), (h["b"], "2025-01-01T00:00:00")], "content_sha256 string, retrieved_at string")
    got = {tuple(r) for r in integrity.snapshot_violations(manifest, raw, receipts, documents).collect()}
    assert got == {("raw", "RAW"), ("raw", "RECEIPT"), ("none", "RAW"), ("none", "RECEIPT"), ("bytes", "RAW_HASH"), ("bytes", "RECEIPT_TIME"), ("bytes", "PATH"), ("extra", "MISSING"), ("extra", "PATH")}


def test_node_properties_and_coverage(spark, units, documents):
    nodes = graph.nodes(documents, units)
    held = {r["key"]: r["properties"] for r in nodes.collect()}
    assert held["s::1/2024/X"]["title"] == "Luật 1/2024/X" and "source_effect_status" not in held["s::1/2024/X"] and held["s::1/2024/X::article::3"]["text"] == "Tên\nxe máy dừng" and held["s"] == {"snapshot_id": "s"}
    assert held["s::1/2024/X::article::3::clause::1"]["parser_version"] == "2" and graph.repeated_nodes(nodes).count() == 0
    assert [(r["key"], r["nodes"]) for r in graph.repeated_nodes(nodes.unionByName(nodes.where("key = 's'"))).collect()] == [("s", 2)]
    vectors = spark.createDataFrame([("1/2024/X::article::3",), ("1/2024/X::article::3",), ("x",), (None,)], "unit_id string")
    assert [tuple(r) for r in dense.coverage(units, vectors).collect()] == [("s", 5, 1, False)]
    questions = spark.createDataFrame([("q1", ["1/2024/X::article::3"], date(2024, 5, 1)), ("q2", ["1/2024/X::article::3"], date(2020, 5, 1)), ("q3", ["none"], None)], "question_id string, gold_unit_ids array<string>, effective_at date")
    ranking = spark.createDataFrame([("q1", "1/2024/X::article::3", 1), ("q9", "x", 1)], "query_id string, unit_id string, rank int")
    assert {tuple(r) for r in evaluation.valid_recall(questions, ranking, units, documents).collect()} == {("q1", 1, 1.0), ("q2", 0, None)}
    assert {tuple(r) for r in evaluation.result_keys(questions, ranking).collect()} == {("q2", "NO_RESULT"), ("q3", "NO_RESULT"), ("q9", "UNKNOWN_QUESTION")}
    digest = lambda df: evaluation.content_digest(df).first()[0]
    assert digest(ranking) == digest(ranking.orderBy("query_id", ascending=False)) != digest(ranking.limit(1)) and digest(ranking.where("false"))


def test_commands(spark, units, documents, tmp_path, capsys):
    root = str(tmp_path)
    units.withColumn("loaded_at", F.lit(datetime(2025, 1, 1))).write.parquet(f"{root}/legal_units.parquet")
    documents.write.parquet(f"{root}/legal_documents.parquet")
    documents.withColumn("delivered_at", F.lit(datetime(2025, 1, 1))).write.parquet(f"{root}/manifest_entries.parquet")
    spark.createDataFrame([], "relation_id string, snapshot_id string, relation_type string, review_status string, source_url string, raw_sha256 string, evidence_unit_id string, source struct<document_id:string,unit_id:string>, target struct<document_id:string,unit_id:string>").write.parquet(f"{root}/relations.parquet")
    spark.createDataFrame([("q1", "xe tải", "dev", ["1/2024/X"], ["1/2024/X::article::3::clause::1"], "t", "ok")], "question_id string, question string, split string, gold_document_ids array<string>, gold_unit_ids array<string>, question_type string, review_status string").write.parquet(f"{root}/gold_questions.parquet")
    spark.createDataFrame([("1/2024/X::article::3::clause::1", [1.0, 0.0])], "unit_id string, vector array<double>").write.parquet(f"{root}/unit_vectors.parquet")
    spark.createDataFrame([("q1", [1.0, 0.1])], "question_id string, vector array<double>").write.parquet(f"{root}/question_vectors.parquet")

    def run(*args):
        code = cli.main([*args, "--root", root, "--snapshot", "s"], spark)
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    assert run("validate-snapshot") == (0, []) and run("validate-relations") == (0, []) and run("validate-gold-set") == (0, [])
    assert all(r["matches"] for r in run("import-graph")[1]) and run("verify-graph") == (0, [])
    assert run("build-lexical-index")[1][0]["units"] == 5
    assert run("search-lexical", "--query", "xe tải")[1][0]["unit_id"].endswith("clause::1")
    assert run("evaluate-r0", "--split", "dev")[1][0]["full_hit"] == 1 and run("evaluate-r1", "--split", "dev")[1][0]["full_hit"] == 1
    assert run("search-lexical", "--query", "xe tải")[1][0].keys() >= {"document_id", "snapshot_id", "text", "unit_type", "source_url", "lexical_score", "validity", "rank"}
    assert run("build-dense-index")[1][0] == {"snapshot_id": "s", "units": 5, "embedded": 1, "complete": False}
    found = run("search-dense", "--query", "[1, 0]")[1][0]
    assert found["dense_score"] == 1.0 and found["source_url"] == "https://x/1/2024/X"
    assert run("build-dense-index", "--encoder", "tests.test_retrieval:letters")[1][0]["complete"] is True and spark.read.parquet(f"{root}/unit_vectors.parquet").count() == 5
    runs = spark.read.parquet(f"{root}/runs.parquet").collect()
    assert len(runs) == 2 and all(len(r["gold_sha256"]) == 64 and r["created_at"] and json.loads(r["config"])["top_k"] == 10 for r in runs)
    assert spark.read.parquet(f"{root}/run_cases.parquet").where("run_id is not null").count() == 2
    assert run("report-snapshot")[1][-1]["unit_count"] == 5
    with pytest.raises(SystemExit):
        run("search-lexical", "--query", "x", "--top-k", "51")
