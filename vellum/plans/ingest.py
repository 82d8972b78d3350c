"""From raw responses to documents and units of a snapshot, with whatever fails set aside under a code."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators import hierarchy, integrity, normalize
from vellum.session import cut
from vellum.sources import portal

NORMALIZER_VERSION, PARSER_VERSION, ARTIFACT_VERSION = "1", "2", "2"


@dataclass
class Ingested:
    """documents and units that passed every step; quarantine: record_id, code (SCHEMA, CATALOG, IDENTITY, TITLE, CORRECTION, HIERARCHY)."""

    documents: DataFrame
    units: DataFrame
    quarantine: DataFrame


def ingest(raw: DataFrame, catalog: DataFrame, strict_quotes: bool = False) -> Ingested:
    """Responses (record_id, payload, retrieved_at) of reviewed sources (see portal.read_catalog), in one job for all.

    A response belongs to the source with its guid: none is CATALOG, another document id IDENTITY, another title (blanks
    aside) TITLE. Corrections must match as often as expected, and units must form a hierarchy. Of several responses to
    one source all are checked and each that passes is a document, so deliver one per source and snapshot.
    """
    parsed, faulty = portal.canonical_documents(raw, "record_id", "payload")
    sources = catalog.select("snapshot_id", F.col("document_guid").alias("portal_document_guid"), "expected_document_id", "expected_title", F.col("expected_public_url").alias("source_url"), F.col("reviewed_text_replacements").alias("corrections"))
    one_space = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    joined = parsed.join(sources, "portal_document_guid", "left").join(raw.select("record_id", "retrieved_at").distinct(), "record_id")
    fixed = normalize.corrected(normalize.html_column(F.col("html")), F.col("corrections"))
    code = (
        F.when(F.col("expected_document_id").isNull(), "CATALOG").when(F.col("document_id") != F.col("expected_document_id"), "IDENTITY")
        .when(one_space(F.col("title")) != one_space(F.col("expected_title")), "TITLE").when(F.size(F.col("fixed.wrong")) > 0, "CORRECTION")
    )
    checked = cut(joined.withColumn("fixed", fixed).withColumn("code", code).drop("html"))
    good = checked.where("code is null").withColumn("text", F.col("fixed.text"))
    units = cut(hierarchy.parse_units(good.withColumn("key", F.concat_ws("#", "document_id", F.col("record_id").cast("string"))).select("key", "text"), "key", "text", strict_quotes))
    # a document's key in the parser is its id and record, so that two responses can't run into each other
    bare = F.regexp_extract("document_id", r"^(.*)#", 1)
    plain = lambda c: F.replace(c, F.col("document_id"), bare)
    named = units.select(F.regexp_extract("document_id", r"#([^#]*)$", 1).alias("record"), bare.alias("document_id"), plain(F.col("unit_id")).alias("unit_id"), "unit_type", "number", "title", "text", plain(F.col("parent_id")).alias("parent_id"), F.transform("path", plain).alias("path"))
    broken = hierarchy.unit_violations(units).select(F.regexp_extract("document_id", r"#([^#]*)$", 1).alias("record")).distinct()
    record = F.col("record_id").cast("string")
    bad = good.select("record_id", record.alias("record")).join(broken.unionByName(good.select(record.alias("record")).join(named.select("record").distinct(), "record", "left_anti")).distinct(), "record", "left_semi").select("record_id").distinct()
    documents = good.join(bad, "record_id", "left_anti").withColumns({"normalized_text": F.col("text"), "corrections_sha256": F.sha2(F.coalesce(F.to_json("corrections"), F.lit("")), 256)}).drop("fixed", "code", "text", "corrections", "expected_document_id", "expected_title").withColumns(
        {"normalizer_version": F.lit(NORMALIZER_VERSION), "parser_version": F.lit(PARSER_VERSION), "artifact_version": F.lit(ARTIFACT_VERSION)}
    )
    kept = named.join(documents.select(record.alias("record"), "snapshot_id"), "record").drop("record")
    set_aside = [faulty, checked.where("code is not null").select("record_id", "code"), bad.select("record_id", F.lit("HIERARCHY").alias("code"))]
    return Ingested(documents, kept, reduce(DataFrame.unionByName, set_aside).distinct())


def manifest_of(documents: DataFrame) -> DataFrame:
    """Manifest rows of parsed documents."""
    return documents.select("snapshot_id", "document_id", "portal_document_guid", "content_sha256", "normalizer_version", "parser_version", "artifact_version")


def catalog_violations(catalog: DataFrame) -> DataFrame:
    """document_guid, code: DUPLICATE (a document id of several rows), URL, CORRECTION (an expected count below 1), NOT_APPROVED."""
    tests = {
        "URL": ~F.startswith("expected_public_url", F.lit("https://")),
        "CORRECTION": F.coalesce(F.exists("reviewed_text_replacements", lambda c: c["expected_count"] < 1), F.lit(False)),
        "NOT_APPROVED": ~F.col("review_status").eqNullSafe(F.lit("approved")),
    }
    several = catalog.groupBy("expected_document_id").agg(F.count("*").alias("n"), F.max("document_guid").alias("document_guid")).where("n > 1").select("document_guid", F.lit("DUPLICATE").alias("code"))
    return integrity._codes(catalog, "document_guid", tests).unionByName(several)
