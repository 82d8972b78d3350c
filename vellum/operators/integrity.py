"""Checks as violation tables: an empty result is a pass, require_empty makes it an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHA256 = r"^[0-9a-f]{64}$"


class IntegrityError(ValueError):
    """A check found violations."""


def require_empty(violations: DataFrame, what: str) -> None:
    """Raises with the first violations where there are any."""
    rows = violations.limit(5).collect()
    if rows:
        raise IntegrityError(f"{what}: " + "; ".join(", ".join(str(v) for v in r) for r in rows))


def _codes(table: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    """key and code for each test that holds; a test that is null holds."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(True)), F.lit(code)) for code, test in tests.items())))
    return table.select(F.col(key), F.explode(found).alias("code")).distinct()


def repeated(table: DataFrame, key: str, code: str) -> DataFrame:
    """Keys with more than one different row."""
    return table.distinct().groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key, F.lit(code).alias("code"))


def _flag(table: DataFrame, known: DataFrame, on: list[str], name: str) -> DataFrame:
    return table.join(known.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def relation_violations(relations: DataFrame, documents: DataFrame, units: DataFrame) -> DataFrame:
    """relation_id, code of reviewed relations that don't resolve in their snapshot.

    Codes: DUPLICATE, SNAPSHOT, TYPE, UNKNOWN_DOCUMENT, NOT_CROSS_DOCUMENT, HASH, URL, SOURCE_UNIT, TARGET_UNIT,
    EVIDENCE, NOT_APPROVED, NOT_HTTPS. A null unit of an endpoint is allowed; a null evidence unit is not. Rows repeated
    as a whole count once. documents and units have one row a key.
    """
    flat = relations.select(
        "relation_id", "snapshot_id", "relation_type", "review_status", "source_url", "raw_sha256", "evidence_unit_id",
        F.col("source.document_id").alias("source_document"), F.col("source.unit_id").alias("source_unit"),
        F.col("target.document_id").alias("target_document"), F.col("target.unit_id").alias("target_unit"),
    ).distinct()
    docs = documents.select("document_id", F.col("content_sha256").alias("doc_hash"), F.col("source_url").alias("doc_url"), F.col("snapshot_id").alias("doc_snapshot"))
    known = units.select("document_id", "unit_id")
    source = docs.select(*(F.col(c).alias(c.replace("document_id", "source_document")) for c in docs.columns)).withColumn("has_source", F.lit(True))
    target = docs.select(F.col("document_id").alias("target_document")).distinct().withColumn("has_target", F.lit(True))
    full = flat.join(source, "source_document", "left").join(target, "target_document", "left")
    for name, doc in (("source_unit", "source_document"), ("target_unit", "target_document"), ("evidence_unit_id", "source_document")):
        full = _flag(full, known.select(F.col("document_id").alias(doc), F.col("unit_id").alias(name)), [doc, name], f"{name}_there")
    has = F.coalesce("has_source", F.lit(False)) & F.coalesce("has_target", F.lit(False))
    tests = {
        "SNAPSHOT": has & ~F.col("snapshot_id").eqNullSafe(F.col("doc_snapshot")),
        "TYPE": ~F.col("relation_type").eqNullSafe(F.lit("AMENDS")),
        "UNKNOWN_DOCUMENT": ~has,
        "NOT_CROSS_DOCUMENT": F.col("source_document").eqNullSafe(F.col("target_document")),
        "HASH": has & ~F.col("raw_sha256").eqNullSafe(F.col("doc_hash")),
        "URL": has & ~F.col("source_url").eqNullSafe(F.col("doc_url")),
        "SOURCE_UNIT": has & F.col("source_unit").isNotNull() & ~F.col("source_unit_there"),
        "TARGET_UNIT": has & F.col("target_unit").isNotNull() & ~F.col("target_unit_there"),
        "EVIDENCE": has & ~F.col("evidence_unit_id_there"),
        "NOT_APPROVED": ~F.col("review_status").eqNullSafe(F.lit("approved")),
        "NOT_HTTPS": ~F.startswith("source_url", F.lit("https://")),
    }
    return _codes(full, "relation_id", tests).unionByName(repeated(flat, "relation_id", "DUPLICATE")).distinct()


def gold_violations(questions: DataFrame, documents: DataFrame, units: DataFrame) -> DataFrame:
    """question_id, code of gold questions that don't resolve.

    Codes: DUPLICATE, NO_DOCUMENTS, NO_UNITS, REPEATED_ID, UNKNOWN_DOCUMENT, UNKNOWN_UNIT, UNIT_OF_OTHER_DOCUMENT, BLANK.
    """
    base = questions.select("question_id", "question", "gold_document_ids", "gold_unit_ids").distinct()
    plain = _codes(base, "question_id", {
        "BLANK": F.trim("question") == "",
        "NO_DOCUMENTS": F.size("gold_document_ids") <= 0,
        "NO_UNITS": F.size("gold_unit_ids") <= 0,
        "REPEATED_ID": (F.size(F.array_distinct("gold_document_ids")) < F.size("gold_document_ids")) | (F.size(F.array_distinct("gold_unit_ids")) < F.size("gold_unit_ids")),
    })
    docs = base.select("question_id", F.explode("gold_document_ids").alias("document_id")).join(documents.select("document_id"), "document_id", "left_anti").select("question_id", F.lit("UNKNOWN_DOCUMENT").alias("code"))
    asked = base.select("question_id", "gold_document_ids", F.explode("gold_unit_ids").alias("unit_id")).join(units.select("unit_id", F.col("document_id").alias("owner")), "unit_id", "left")
    unit = asked.select("question_id", F.when(F.col("owner").isNull(), "UNKNOWN_UNIT").when(~F.array_contains("gold_document_ids", F.col("owner")), "UNIT_OF_OTHER_DOCUMENT").alias("code")).where("code is not null")
    return reduce(DataFrame.unionByName, [plain, docs, unit, repeated(base, "question_id", "DUPLICATE")]).distinct()


def gold_profile(questions: DataFrame) -> DataFrame:
    """field (split, question_type, review_status), value, questions: counts of distinct questions."""
    base = questions.select("question_id", F.lower(F.trim("split")).alias("split"), "question_type", "review_status").distinct()
    long = base.select("question_id", F.expr("stack(3, 'split', split, 'question_type', question_type, 'review_status', review_status) as (field, value)"))
    return long.groupBy("field", "value").agg(F.count_distinct("question_id").alias("questions"))


def document_violations(documents: DataFrame) -> DataFrame:
    """document_id, code: DUPLICATE (different rows), TITLE, HASH, URL, STATUS, SNAPSHOT, DATES (ends before it begins)."""
    tests = {
        "TITLE": F.trim("title") == "",
        "HASH": ~F.col("content_sha256").rlike(SHA256),
        "URL": ~(F.startswith("source_url", F.lit("https://")) & F.startswith("content_url", F.lit("https://"))),
        "STATUS": ~F.col("status").isin("current", "repealed", "amended", "unknown"),
        "SNAPSHOT": F.trim("snapshot_id") == "",
        "DATES": F.coalesce(F.col("effective_to") < F.col("effective_from"), F.lit(False)),
    }
    return _codes(documents, "document_id", tests).unionByName(repeated(documents, "document_id", "DUPLICATE")).distinct()


def manifest_violations(manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, code: how one snapshot's manifest and its parsed documents disagree.

    Codes: MISSING (no document), EXTRA (no entry), HASH, GUID, NORMALIZER, PARSER, ARTIFACT (values differ, nulls too).
    Both sides have one row a document.
    """
    compared = {"HASH": "content_sha256", "GUID": "portal_document_guid", "NORMALIZER": "normalizer_version", "PARSER": "parser_version", "ARTIFACT": "artifact_version"}
    m = manifest.select("document_id", F.lit(True).alias("listed"), *(F.col(c).alias(f"m_{c}") for c in compared.values()))
    p = documents.select("document_id", F.lit(True).alias("parsed"), *(F.col(c).alias(f"p_{c}") for c in compared.values()))
    both = F.col("listed").isNotNull() & F.col("parsed").isNotNull()
    tests = {"MISSING": F.col("parsed").isNull(), "EXTRA": F.col("listed").isNull()} | {code: both & ~F.col(f"m_{c}").eqNullSafe(F.col(f"p_{c}")) for code, c in compared.items()}
    return _codes(m.join(p, "document_id", "full_outer"), "document_id", tests)


def snapshot_violations(manifest: DataFrame, raw: DataFrame, receipts: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, code: how a snapshot's manifest, raw responses, receipts and parsed documents disagree.

    raw: content_sha256, payload; receipts: content_sha256, retrieved_at (text in ISO form). Besides the codes of
    manifest_violations: RAW (no response of the entry's hash), RAW_HASH (its bytes have another hash), RECEIPT (none),
    RECEIPT_TIME (no time with an offset), PATH (a parsed_path that leaves its folder). Hashes are compared without
    regard to case; a null hash has no response. Several rows of a hash count as wrong if one of them is.
    """
    key = lambda c: F.lower(c)
    held = raw.groupBy(key("content_sha256").alias("hash")).agg(F.bool_and(F.sha2("payload", 256) == key("content_sha256")).alias("whole"))
    timed = receipts.groupBy(key("content_sha256").alias("hash")).agg(F.bool_and(F.coalesce(F.col("retrieved_at").rlike(r"^\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}:?\d{2})$"), F.lit(False))).alias("timed"))
    full = manifest.withColumn("hash", key("content_sha256")).join(held, "hash", "left").join(timed, "hash", "left")
    path = F.col("parsed_path") if "parsed_path" in manifest.columns else F.lit("")
    tests = {
        "RAW": F.col("whole").isNull(), "RAW_HASH": F.coalesce(~F.col("whole"), F.lit(False)), "RECEIPT": F.col("timed").isNull(), "RECEIPT_TIME": F.coalesce(~F.col("timed"), F.lit(False)),
        "PATH": F.coalesce(path.rlike(r"(^|/)\.\.(/|$)|^/|\\"), F.lit(False)),
    }
    return manifest_violations(manifest, documents).unionByName(_codes(full, "document_id", tests))


def key_set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of only one side: key, side (left, right)."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    return a.join(b, key, "full_outer").where("l is null or r is null").select(key, F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def snapshot_report(documents: DataFrame, units: DataFrame) -> DataFrame:
    """Per document its status and units by type, and the totals in a row of null document_id."""
    types = ("part", "chapter", "section", "article", "clause", "point")
    counted = units.groupBy("document_id").agg(F.count("*").alias("unit_count"), *(F.count_if(F.col("unit_type") == t).alias(f"{t}_count") for t in types))
    rows = documents.select("document_id", "status", "effective_from", "content_sha256").join(counted, "document_id", "left").na.fill(0)
    total = rows.agg(*(F.sum(c).cast("long").alias(c) for c in ["unit_count", *(f"{t}_count" for t in types)]))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("document_id", "string"), ("status", "string"), ("effective_from", "date"), ("content_sha256", "string"))]
    return rows.unionByName(total.select(*nothing, *total.columns))


def metadata_presence(documents: DataFrame) -> DataFrame:
    """One row: documents, how many have each kind of metadata, and how many have an unknown status."""
    has = {c: F.col(c).isNotNull() for c in ("portal_document_type", "source_effect_status")} | {c: F.coalesce(F.size(c) > 0, F.lit(False)) for c in ("fields", "majors", "issuing_organs", "signers")}
    return documents.agg(F.count("*").alias("documents"), *(F.count_if(test).alias(c) for c, test in has.items()), F.count_if(F.col("status") == "unknown").alias("unknown_status"))


def effective(begins: Column, ends: Column, status: Column, day: Column) -> Column:
    """true, false or unknown: whether a law is in force on a day, from its dates and status, never by newest wins."""
    return F.when(begins.isNull() | day.isNull(), "unknown").when(day < begins, "false").when(ends.isNotNull() & (day > ends), "false").when(ends.isNull() & (status == "repealed"), "unknown").otherwise("true")
