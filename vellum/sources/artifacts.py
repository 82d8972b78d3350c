"""Tables a snapshot is kept in: write-once raw responses with receipts, parsed tables by snapshot, and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import folder_exists


def file_component(value: Column) -> Column:
    """Percent-encoded, with no character kept but letters, digits, '_', '.', '-' and '~'."""
    return F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def first_receipts(raw: DataFrame, payload: str, retrieved: str) -> DataFrame:
    """One row per content: content_sha256, the first time it was retrieved, deliveries. Null payloads have none."""
    hashed = raw.where(F.col(payload).isNotNull()).select(F.sha2(payload, 256).alias("content_sha256"), F.col(retrieved).alias("at"))
    return hashed.groupBy("content_sha256").agg(F.min("at").alias("retrieved_at"), F.count("*").alias("deliveries"))


def new_contents(raw: DataFrame, stored: DataFrame, payload: str) -> DataFrame:
    """Contents not stored yet, once each: content_sha256, payload."""
    fresh = raw.where(F.col(payload).isNotNull()).select(F.sha2(payload, 256).alias("content_sha256"), F.col(payload).alias("payload")).dropDuplicates(["content_sha256"])
    return fresh.join(stored.select("content_sha256"), "content_sha256", "left_anti")


def collisions(new: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """Keys of a write-once table that would be written with another content."""
    return new.select(key, F.col(content).alias("new")).join(stored.select(key, F.col(content).alias("old")), key).where("not (new <=> old)").select(key).distinct()


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key isn't in new. A null key of old stays."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


class WriteOnceError(ValueError):
    """A key of a write-once table would get another content."""


def write_once(new: DataFrame, path: str, key: list[str], content: str) -> None:
    """Adds rows whose key the table at path doesn't hold; a key it holds with another content is an error, nothing is written.

    Rows of one key in new must agree too. A row that is already there is left as it is, so that writing again is safe.
    """
    spark = new.sparkSession
    fresh = new
    if folder_exists(spark, path):
        stored = spark.read.parquet(path).select(*key, F.col(content).alias("__old"))
        both = new.join(stored, key, "left")
        wrong = both.where(f"__old is not null and not ({content} <=> __old)").select(*key).limit(3).collect()
        if wrong:
            raise WriteOnceError(f"{path}: other content for {', '.join(str(tuple(r)) for r in wrong)}")
        fresh = new.join(stored.select(*key), key, "left_anti")
    several = new.groupBy(*key).agg(F.count_distinct(content).alias("n")).where("n > 1").limit(3).collect()
    if several:
        raise WriteOnceError(f"{path}: several contents for {', '.join(str(tuple(r)[:-1]) for r in several)}")
    fresh.dropDuplicates(key).write.mode("append").parquet(path)


def store_normalized(texts: DataFrame, path: str) -> None:
    """Write-once store of normalized texts: content_sha256, normalizer_version, corrections_sha256, text (ends in a line end)."""
    ended = texts.select("content_sha256", "normalizer_version", "corrections_sha256", F.concat("text", F.lit("\n")).alias("text"))
    write_once(ended, path, ["content_sha256", "normalizer_version", "corrections_sha256"], "text")


ENDPOINT = "STRUCT<document_id: STRING, unit_id: STRING>"
RELATION = f"""STRUCT<relation_id: STRING, relation_type: STRING, amendment_type: STRING, source: {ENDPOINT}, target: {ENDPOINT}, evidence_unit_id: STRING,
    source_url: STRING, raw_sha256: STRING, provenance: STRING, review_status: STRING, reviewed_by: STRING, reviewed_at: DATE, note: STRING>"""
QUESTION = """STRUCT<question_id: STRING, question: STRING, question_type: STRING, difficulty: STRING, split: STRING, effective_at: DATE,
    gold_document_ids: ARRAY<STRING>, gold_unit_ids: ARRAY<STRING>, reviewer_notes: STRING, review_status: STRING>"""


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """Approved relations of artifact files, flat; a file that isn't in the form is an error."""
    files = spark.read.schema(f"artifact_version STRING, snapshot_id STRING, relations ARRAY<{RELATION}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return files.select("artifact_version", "snapshot_id", F.explode("relations").alias("r")).select("artifact_version", "snapshot_id", "r.*")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold questions of artifact files, flat; a file that isn't in the form is an error."""
    files = spark.read.schema(f"artifact_version STRING, snapshot_id STRING, evaluation_scope STRING, questions ARRAY<{QUESTION}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return files.select("artifact_version", "snapshot_id", "evaluation_scope", F.explode("questions").alias("q")).select("artifact_version", "snapshot_id", "evaluation_scope", "q.*")


def write_snapshot(table: DataFrame, path: str) -> None:
    """Writes a table by snapshot_id; only the snapshots it holds are replaced."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def read_snapshot(spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    """One snapshot of a table (only its folder is read)."""
    return spark.read.parquet(path).where(F.col("snapshot_id") == snapshot_id)
