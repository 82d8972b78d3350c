"""Raw source responses: fetching, validation against the response schema, and canonical documents."""

from __future__ import annotations

from urllib.parse import quote
from urllib.request import HTTPRedirectHandler, Request, build_opener

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = """success BOOLEAN, tabName STRING, data STRUCT<docGUId: STRING, docIdentity: STRING, docName: STRING, docContent: STRING,
issueDate: STRING, effectDate: STRING, expireDate: STRING, effectStatus: STRUCT<effectStatusName: STRING>, docType: STRUCT<docTypeName: STRING>,
fields: ARRAY<STRUCT<fieldName: STRING>>, majors: ARRAY<STRUCT<majorName: STRING>>, organs: ARRAY<STRUCT<organName: STRING>>,
signers: ARRAY<STRUCT<signerName: STRING, jobTitleName: STRING>>>"""
# The only address that is fetched, and the bounds of a response.
DETAIL = "https://phapluat.gov.vn/api/legal-documents/detail"
TIMEOUT_S, MAX_BYTES = 20, 2_000_000


def detail_url(guid: str, endpoint: str = DETAIL) -> str:
    """The one URL that is fetched for a source: the guid is a single encoded value, whatever characters it holds."""
    return f"{endpoint}?docGUId={quote(guid, safe='')}&tabName=noidung"


class _NoRedirect(HTTPRedirectHandler):
    def redirect_request(self, *_: object) -> None:
        return None


def select_source(catalog: DataFrame, document_id: str) -> DataFrame:
    """The reviewed source of a document; an error if the catalog has none."""
    found = catalog.where(F.col("expected_document_id") == document_id)
    if found.isEmpty():
        raise LookupError(f"{document_id} is not in the catalog")
    return found


def correction_count(catalog: DataFrame) -> DataFrame:
    """One row: sources and reviewed text corrections of a catalog."""
    return catalog.agg(F.count("*").alias("sources"), F.coalesce(F.sum(F.greatest(F.lit(0), F.coalesce(F.size("reviewed_text_replacements"), F.lit(0)))), F.lit(0)).alias("corrections"))


def fetch_raw(url: str, timeout: float = TIMEOUT_S, most: int = MAX_BYTES) -> bytes:
    """One response body; only https, status 200 and at most `most` bytes; redirects aren't followed."""
    if not url.startswith("https://"):
        raise ValueError("only https is fetched")
    with build_opener(_NoRedirect).open(Request(url, headers={"Accept": "application/json"}), timeout=timeout) as response:  # noqa: S310
        if response.status != 200:
            raise OSError(f"FETCH: status {response.status}")
        body = response.read(most + 1)
    if len(body) > most:
        raise OSError("FETCH: response is too large")
    return body


def read_raw_files(spark: SparkSession, path: str) -> DataFrame:
    """Saved responses of a folder: path, content_sha256, payload (bytes as UTF-8 text)."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("content_sha256"), F.decode("content", "UTF-8").alias("payload"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed sources of a catalog file, one row each, with the catalog's snapshot_id."""
    source = "ARRAY<STRUCT<document_guid: STRING, expected_document_id: STRING, expected_title: STRING, expected_public_url: STRING, review_status: STRING, reviewed_text_replacements: ARRAY<STRUCT<find: STRING, replace: STRING, expected_count: INT, evidence_url: STRING, reason: STRING>>>>"
    return spark.read.schema(f"snapshot_id STRING, sources {source}").option("multiLine", True).json(path).select("snapshot_id", F.explode("sources").alias("s")).select("snapshot_id", "s.*")


def map_status(status: Column) -> Column:
    """current, repealed, amended or unknown, by the source's label (null is unknown)."""
    return F.when(status == "Còn hiệu lực", "current").when(status == "Hết hiệu lực", "repealed").when(status == "Hết hiệu lực một phần", "amended").otherwise("unknown")


def document_type(document_id: Column) -> Column:
    """law, decree, circular, decision or other, by the id's parts in this order."""
    kinds = (("/QH", "law"), ("/NĐ-CP", "decree"), ("/TT-", "circular"), ("/QĐ-", "decision"))
    out = F.when(F.lit(False), "")
    for part, kind in kinds:
        out = out.when(F.contains(document_id, F.lit(part)), kind)
    return out.otherwise("other")


def midnight_date(text: Column) -> Column:
    """A date from ISO text that is a day or midnight of a day; '' and null give null. Other text gives null too."""
    whole = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:T00:00(?::00(?:\.0+)?)?(?:Z|[+-]00:00)?)?$", 1)
    return F.try_to_date(F.nullif(whole, F.lit("")))


def _names(array: str, name: str) -> Column:
    """Distinct names in order; null arrays are empty."""
    return F.coalesce(F.array_distinct(F.array_compact(F.transform(array, lambda x: x[name]))), F.array().cast("array<string>"))


def _valid() -> Column:
    """Whether the parsed payload v has the response schema: kinds of values, required texts, success, whole days.

    Checked on the JSON itself, as reading it under a schema would turn other kinds of values into text or null.
    """
    part = lambda path: F.expr(f"try_variant_get(v, '$.{path}', 'variant')")
    text = lambda path: F.expr(f"try_variant_get(v, '$.{path}', 'string')")
    # VOID is a JSON null; a missing value has no kind
    kind = lambda path: F.coalesce(F.schema_of_variant(part(path)), F.lit("VOID"))
    valid = F.col("v").isNotNull() & (kind("success") == "BOOLEAN") & (text("success") == "true") & (kind("tabName") == "STRING")
    for c in ("docGUId", "docIdentity", "docName", "docContent"):
        valid = valid & (kind(f"data.{c}") == "STRING") & (F.trim(text(f"data.{c}")) != "")
    for c in ("issueDate", "effectDate", "expireDate"):
        day = (kind(f"data.{c}") == "STRING") & ((text(f"data.{c}") == "") | midnight_date(text(f"data.{c}")).isNotNull())
        valid = valid & ((kind(f"data.{c}") == "VOID") | day)
    for c, name in (("effectStatus", "effectStatusName"), ("docType", "docTypeName")):
        valid = valid & ((kind(f"data.{c}") == "VOID") | F.startswith(kind(f"data.{c}"), F.lit("OBJECT")) & (kind(f"data.{c}.{name}") == "STRING"))
    for c in ("fields", "majors", "organs", "signers"):
        valid = valid & kind(f"data.{c}").rlike("^(VOID|ARRAY<(VOID|OBJECT).*)$")
    return valid


def canonical_documents(records: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine) of raw responses.

    documents: key, portal_document_guid, document_id, title, html, document_type, portal_document_type, issuer, fields,
    majors, issuing_organs, signers, issued_date, effective_from, effective_to, source_effect_status, status,
    content_sha256. quarantine: key, code (SCHEMA for invalid JSON, wrong or missing required fields, success not true,
    or a date that isn't a day). Unknown keys are ignored; rows repeated as a whole come once.
    """
    parsed = records.select(F.col(key).alias("key"), F.col(payload).alias("payload")).distinct().withColumn("v", F.try_parse_json("payload"))
    checked = parsed.withColumn("valid", F.coalesce(_valid(), F.lit(False))).drop("v").withColumn("r", F.from_json("payload", ENVELOPE)).withColumn("d", F.col("r.data"))
    organs = _names("d.organs", "organName")
    documents = checked.where("valid").select(
        F.col("key").alias(key), F.col("d.docGUId").alias("portal_document_guid"), F.col("d.docIdentity").alias("document_id"), F.col("d.docName").alias("title"), F.col("d.docContent").alias("html"),
        document_type(F.col("d.docIdentity")).alias("document_type"), F.col("d.docType.docTypeName").alias("portal_document_type"), F.try_element_at(organs, F.lit(1)).alias("issuer"),
        _names("d.fields", "fieldName").alias("fields"), _names("d.majors", "majorName").alias("majors"), organs.alias("issuing_organs"),
        F.transform("d.signers", lambda s: F.struct(s["signerName"].alias("name"), F.nullif(s["jobTitleName"], F.lit("")).alias("job_title"))).alias("signers"),
        midnight_date(F.col("d.issueDate")).alias("issued_date"), midnight_date(F.col("d.effectDate")).alias("effective_from"), midnight_date(F.col("d.expireDate")).alias("effective_to"),
        F.col("d.effectStatus.effectStatusName").alias("source_effect_status"), map_status(F.col("d.effectStatus.effectStatusName")).alias("status"), F.sha2("payload", 256).alias("content_sha256"),
    )
    return documents, checked.where("not valid").select(F.col("key").alias(key), F.lit("SCHEMA").alias("code"))


def identity_violations(documents: DataFrame, catalog: DataFrame) -> DataFrame:
    """document_guid, code of catalog rows whose document is MISSING, has another id (IDENTITY) or another title (TITLE)."""
    one_space = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    found = documents.select(F.col("portal_document_guid").alias("document_guid"), "document_id", "title")
    both = catalog.select("document_guid", "expected_document_id", "expected_title").join(found, "document_guid", "left")
    code = F.when(F.col("document_id").isNull(), "MISSING").when(F.col("document_id") != F.col("expected_document_id"), "IDENTITY").when(one_space(F.col("title")) != one_space(F.col("expected_title")), "TITLE")
    return both.select("document_guid", code.alias("code")).where("code is not null").distinct()
