"""Commands over a folder of Parquet tables: python -m vellum.cli COMMAND --root FOLDER ...

Each prints its result as JSON lines; a command that checks something ends with status 1 where it found violations.
"""

from __future__ import annotations

import argparse
import hashlib
import importlib
import json
import os
import subprocess
import sys
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import dense, evaluation, graph, integrity, lexical
from vellum.plans import ingest
from vellum.session import cut, folder_exists, table
from vellum.sources import artifacts, portal

Command = Callable[[SparkSession, argparse.Namespace], DataFrame]
COMMANDS: dict[str, Command] = {}
#: Commands whose rows are violations.
CHECKS = {"rebuild-snapshot", "validate-snapshot", "validate-relations", "validate-gold-set", "verify-graph"}


def command(name: str) -> Callable[[Command], Command]:
    def keep(f: Command) -> Command:
        COMMANDS[name] = f
        return f

    return keep


def _snapshot(spark: SparkSession, a: argparse.Namespace, name: str, key: str, later: str | None = None) -> DataFrame:
    rows = table(spark, a.root, name)
    return graph.one_row_each(rows.where(F.col("snapshot_id") == a.snapshot) if a.snapshot else rows, key, later)


def _documents(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return _snapshot(spark, a, "legal_documents", "document_id")


def _units(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return _snapshot(spark, a, "legal_units", "unit_id", "loaded_at")


def _relations(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = table(spark, a.root, "relations").distinct()
    return rows.where(F.col("snapshot_id") == a.snapshot) if a.snapshot else rows


def _gold(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = graph.one_row_each(table(spark, a.root, "gold_questions"), "question_id")
    return rows.where(F.lower(F.trim("split")) == a.split) if a.split else rows


def _store(spark: SparkSession, a: argparse.Namespace, sources: DataFrame) -> DataFrame:
    """Fetches reviewed sources one by one; a failure is a row, not the end. Responses are stored once by guid and hash."""
    rows = []
    # a catalog is a reviewed list, written by hand
    for guid in [r[0] for r in sources.select("document_guid").collect()]:
        try:
            body = portal.fetch_raw(portal.detail_url(guid, a.endpoint))
            rows.append((guid, hashlib.sha256(body).hexdigest(), body.decode("utf-8", "replace"), datetime.now(UTC).isoformat(), None))
        except (OSError, ValueError) as e:
            rows.append((guid, None, None, None, f"FETCH: {e}"))
    got = spark.createDataFrame(rows, "document_guid string, content_sha256 string, payload string, retrieved_at string, error string")
    artifacts.write_once(got.where("error is null").drop("error"), f"{a.root}/raw.parquet", ["document_guid", "content_sha256"], "payload")
    return got.drop("payload")


@command("fetch-portal")
def fetch_portal(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The reviewed source of one document (--document); nothing outside the catalog is fetched."""
    return _store(spark, a, portal.select_source(portal.read_catalog(spark, a.catalog), a.document))


@command("fetch-catalog")
def fetch_catalog(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return _store(spark, a, portal.read_catalog(spark, a.catalog))


@command("rebuild-snapshot")
def rebuild_snapshot(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """From stored responses alone, of each source the one retrieved first; documents built before must keep their guid and hash."""
    catalog = portal.read_catalog(spark, a.catalog)
    integrity.require_empty(ingest.catalog_violations(catalog), "CATALOG")
    first = F.min_by(F.struct("payload", "retrieved_at", "content_sha256"), "retrieved_at").alias("r")
    raw = table(spark, a.root, "raw").groupBy(F.col("document_guid").alias("record_id")).agg(first).select("record_id", "r.payload", "r.retrieved_at")
    done = ingest.ingest(raw, catalog)
    manifest = ingest.manifest_of(done.documents)
    if folder_exists(spark, f"{a.root}/manifest_entries.parquet"):
        key = ["snapshot_id", "document_id"]
        stored = table(spark, a.root, "manifest_entries").select(*key, F.concat_ws("|", "portal_document_guid", "content_sha256").alias("identity"))
        built = manifest.select(F.concat_ws("::", *key).alias("key"), F.concat_ws("|", "portal_document_guid", "content_sha256").alias("identity"))
        integrity.require_empty(artifacts.collisions(built, stored.select(F.concat_ws("::", *key).alias("key"), "identity"), "key", "identity"), "REBUILD")
    artifacts.write_snapshot(done.documents, f"{a.root}/legal_documents.parquet")
    artifacts.write_snapshot(done.units, f"{a.root}/legal_units.parquet")
    artifacts.write_snapshot(manifest, f"{a.root}/manifest_entries.parquet")
    artifacts.store_normalized(done.documents.select("content_sha256", "normalizer_version", "corrections_sha256", F.col("normalized_text").alias("text")), f"{a.root}/normalized.parquet")
    return done.quarantine


@command("validate-snapshot")
def validate_snapshot(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The manifest against documents, and against raw responses and receipts where the folder has them."""
    manifest, documents = _snapshot(spark, a, "manifest_entries", "document_id", "delivered_at"), _documents(spark, a)
    if folder_exists(spark, f"{a.root}/raw.parquet"):
        raw = table(spark, a.root, "raw")
        found = integrity.snapshot_violations(manifest, raw, raw.select("content_sha256", "retrieved_at"), documents)
    else:
        found = integrity.manifest_violations(manifest, documents)
    return found.unionByName(integrity.document_violations(documents))


@command("import-graph")
def import_graph(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    documents, units, relations = _documents(spark, a), _units(spark, a), _relations(spark, a)
    # everything is validated before anything is written
    integrity.require_empty(integrity.relation_violations(relations, documents, units), "GRAPH")
    graph.nodes(documents, units).write.mode("overwrite").parquet(f"{a.root}/graph_nodes.parquet")
    graph.edges(documents, units, relations).write.mode("overwrite").parquet(f"{a.root}/graph_edges.parquet")
    return _counts(spark, a)


def _counts(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    observed = graph.observed_counts(table(spark, a.root, "graph_nodes"), table(spark, a.root, "graph_edges"))
    return graph.reconcile(graph.expected_counts(_documents(spark, a), _units(spark, a), _relations(spark, a)), observed)


@command("verify-graph")
def verify_graph(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return _counts(spark, a).where("not matches")


@command("validate-relations")
def validate_relations(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return integrity.relation_violations(_relations(spark, a), _documents(spark, a), _units(spark, a))


@command("validate-gold-set")
def validate_gold_set(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return integrity.gold_violations(table(spark, a.root, "gold_questions"), _documents(spark, a), _units(spark, a))


@command("build-lexical-index")
def build_lexical_index(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    lexical.postings(_units(spark, a), "unit_id", "text").write.mode("overwrite").parquet(f"{a.root}/postings.parquet")
    return lexical.index_stats(table(spark, a.root, "postings"))


def _query(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return lexical.normalized_queries(spark.createDataFrame([("query", a.query)], "id string, text string"), "id", "text")


def _postings(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """The stored index, of the snapshot's units; None where it was never built."""
    if not folder_exists(spark, f"{a.root}/postings.parquet"):
        return None
    return table(spark, a.root, "postings").join(_units(spark, a).select("unit_id"), "unit_id", "left_semi")


@command("search-lexical")
def search_lexical(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    found = lexical.search(_query(spark, a), _units(spark, a), _documents(spark, a), a.top_k, _postings(spark, a))
    return lexical.described(found, _units(spark, a), _documents(spark, a)).orderBy("rank")


def _run(spark: SparkSession, a: argparse.Namespace, ranking: DataFrame, name: str) -> DataFrame:
    """The scored run with its provenance, kept under runs.parquet; results of unknown questions are an error."""
    gold = _gold(spark, a)
    integrity.require_empty(evaluation.result_keys(gold, ranking).where("code = 'UNKNOWN_QUESTION'"), "RESULTS")
    cases = cut(evaluation.evaluation_cases(gold, ranking))
    config = {"name": name, "top_k": a.top_k} | ({"k1": lexical.K1, "b": lexical.B} if name == "r0" else {"score": "cosine", "encoder": a.encoder})
    run = cut(evaluation.run_record(name, evaluation.evaluation_metrics(cases), gold, a.snapshot, a.split, config, _commit()))
    run.write.mode("append").parquet(f"{a.root}/runs.parquet")
    cases.withColumn("run_id", run.select("run_id").scalar()).write.mode("append").parquet(f"{a.root}/run_cases.parquet")
    return run


def _commit() -> str | None:
    """The commit of the code that runs; None outside a checkout."""
    folder = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    return done.stdout.strip() or None


@command("evaluate-r0")
def evaluate_r0(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    asked = lexical.normalized_queries(_gold(spark, a), "question_id", "question")
    ranking = lexical.search(asked, _units(spark, a), _documents(spark, a), a.top_k, _postings(spark, a)).join(_units(spark, a).select("unit_id", "document_id"), "unit_id")
    return _run(spark, a, ranking, "r0")


@command("build-dense-index")
def build_dense_index(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Writes vectors of the units that lack one to unit_vectors (unit_id, vector) and tells how far the index is complete.

    --encoder names a function, module:name, that gives the encoder of dense.encode; without one nothing is written.
    """
    path, inputs = f"{a.root}/unit_vectors.parquet", dense.embedding_texts(_units(spark, a), _documents(spark, a))
    there = folder_exists(spark, path)
    missing = dense.missing_embeddings(inputs, table(spark, a.root, "unit_vectors"), "unit_id") if there else inputs
    if a.encoder:
        module, name = a.encoder.split(":")
        cut(dense.encode(missing, "unit_id", "text", getattr(importlib.import_module(module), name), a.batch_size)).write.mode("append").parquet(path)
    elif not there:
        raise ValueError("no vectors are stored and no --encoder is named")
    return dense.coverage(_units(spark, a), table(spark, a.root, "unit_vectors"))


def _vectors(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Stored vectors of the snapshot's units."""
    return table(spark, a.root, "unit_vectors").join(_units(spark, a).select("unit_id"), "unit_id", "left_semi")


@command("search-dense")
def search_dense(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Units nearest to a vector given as JSON."""
    asked = spark.createDataFrame([("query", [float(x) for x in json.loads(a.query)])], "unit_id string, vector array<double>")
    found = dense.cosine_topk(asked, _vectors(spark, a), "unit_id", "vector", a.top_k)
    return lexical.described(found, _units(spark, a), _documents(spark, a)).orderBy("dense_rank")


@command("evaluate-r1")
def evaluate_r1(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Rankings by question_vectors (question_id, vector) over unit_vectors."""
    asked = table(spark, a.root, "question_vectors").join(_gold(spark, a).select("question_id"), "question_id", "left_semi").select(F.col("question_id").alias("unit_id"), "vector")
    found = dense.cosine_topk(asked, _vectors(spark, a), "unit_id", "vector", a.top_k)
    return _run(spark, a, found.select("query_id", "unit_id", F.col("dense_rank").alias("rank")).join(_units(spark, a).select("unit_id", "document_id"), "unit_id"), "r1")


@command("report-snapshot")
def report_snapshot(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return integrity.snapshot_report(_documents(spark, a), _units(spark, a)).orderBy(F.asc_nulls_last("document_id"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vellum")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("--root", required=True)
    for name in ("snapshot", "catalog", "document", "query", "split", "encoder"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--endpoint", default=portal.DETAIL)
    parser.add_argument("--batch-size", type=int, default=32)
    parser.add_argument("--top-k", type=int, default=10)
    a = parser.parse_args(argv)
    if not 1 <= a.top_k <= 50:
        parser.error("--top-k must be between 1 and 50")
    if a.split not in (None, "dev", "test"):
        parser.error("--split must be dev or test")
    spark = spark or SparkSession.builder.appName("vellum").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    n = failed = 0
    for n, row in enumerate(COMMANDS[a.command](spark, a).toJSON().toLocalIterator(), 1):
        print(row)
        failed += json.loads(row).get("error") is not None
    return int(a.command in CHECKS and n > 0 or failed > 0)


if __name__ == "__main__":
    sys.exit(main())
