"""The core operators on the test tables, with the SQL they are checked against (see oracles)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions.text import key_form
from vellum.operators import dense, drift, evaluation, graph, hierarchy, integrity, lexical, normalize, snapshots
from vellum.plans.oracles import ORACLES as ORACLES
from vellum.session import cut, table
from vellum.sources import artifacts, portal

#: Fields of the portal payloads under the names known beforehand, the one they go by first; further names are found.
PORTAL_COLUMNS = {
    "guid": (["data.docGUId"], "string"),
    "identity": (["data.docIdentity"], "string"),
    "name": (["data.docName"], "string"),
    "content": (["data.docContent", "data.docContent.html", "data.content", "data.noiDung", "data.body.value"], "string"),
    "effect_status": (["data.effectStatus.effectStatusName", "data.effectStatusName", "data.effectStatus"], "string"),
    "issue_date": (["data.issueDate", "data.ngayBanHanh"], "date"),
    "effect_date": (["data.effectDate"], "date"),
    "expire_date": (["data.expireDate"], "date"),
    "doc_type": (["data.docType.docTypeName"], "string"),
    "fields": (["data.fields.fieldName"], "array"),
    "majors": (["data.majors.majorName"], "array"),
    "organs": (["data.organs.organName", "data.issuingOrgans.organName"], "array"),
    "signers": (["data.signers.signerName"], "array"),
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _units(spark: SparkSession, d: str) -> DataFrame:
    return graph.one_row_each(table(spark, d, "legal_units"), "unit_id", "loaded_at")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return graph.one_row_each(table(spark, d, "legal_documents"), "document_id")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return graph.one_row_each(table(spark, d, "gold_questions"), "question_id")


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relations").distinct()


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return graph.one_row_each(table(spark, d, "candidates"), "candidate_id")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: questions whose number is divisible by 20."""
    return _questions(spark, d).where("cast(regexp_extract(question_id, '(\\\\d+)$', 1) as bigint) % 20 = 0")


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    """The stored candidates of each question as one ranking: exact before lexical, ties by unit."""
    rank = "row_number() over (partition by question_id order by exact_rank asc nulls last, lexical_rank asc nulls last, dense_rank asc nulls last, unit_id, candidate_id)"
    return _candidates(spark, d).select(F.col("question_id").alias("query_id"), "unit_id", "document_id", F.expr(rank).alias("rank"))


# problems of the core


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manifest_entries")
    formed = rows.select("snapshot_id", key_form(F.col("document_id")).alias("document_id"), key_form(F.col("content_sha256")).alias("content_sha256"), "parser_version", "delivered_at")
    return snapshots.snapshot_changes(formed, table(spark, d, "snapshots"), "document_id", ["content_sha256", "parser_version"])


@query
def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_counts(p1_found(spark, d))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "portal_records"), "feed", "file_no", "file_name", "payload").select("file_name", "change", "old_path", "new_path").distinct()


@query
def p5_lifespans(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "portal_records")
    spans = drift.lifespans(drift.catalogue(records, "feed", "file_no", "payload"), drift.files_of(records, "feed", "file_no", "file_name"))
    return spans.select("feed", "path", "type", "first_file", "last_file", "files", "open_end")


@query
def p5_table(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "portal_records")
    changes = drift.schema_changes(records, "feed", "file_no", "file_name", "payload")
    flat = drift.consistent_table(records, "record_id", "feed", "file_no", "file_name", "payload", PORTAL_COLUMNS, changes)
    return flat.select("record_id", "feed", "file_no", *(F.array_join(c, "; ").alias(c) if kind == "array" else F.col(c) for c, (_, kind) in PORTAL_COLUMNS.items()), "other", "uncast")


@query
def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    """How many records of each feed have a value in each column of the consistent table."""
    named = p5_table(spark, d)
    return named.groupBy("feed").agg(F.count("*").alias("records"), *(F.count(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(c) for c in PORTAL_COLUMNS), F.count("uncast").alias("uncast"))


# sources and sinks


@query
def canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    documents, _ = portal.canonical_documents(table(spark, d, "portal_records"), "record_id", "payload")
    flat = [F.array_join(c, "; ").alias(c) for c in ("fields", "majors", "issuing_organs")]
    return documents.select("record_id", "portal_document_guid", "document_id", "title", "document_type", "portal_document_type", "issuer", *flat, F.coalesce(F.size("signers"), F.lit(0)).cast("long").alias("signers"), "issued_date", "effective_from", "source_effect_status", "status", "content_sha256")


@query
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    return portal.canonical_documents(table(spark, d, "portal_records"), "record_id", "payload")[1]


@query
def catalog_identity(spark: SparkSession, d: str) -> DataFrame:
    """Each law as a catalog row against what the portal delivered under its guid."""
    catalog = _documents(spark, d).select(F.col("portal_document_guid").alias("document_guid"), F.col("document_id").alias("expected_document_id"), F.col("title").alias("expected_title"))
    delivered, _ = portal.canonical_documents(table(spark, d, "portal_records"), "record_id", "payload")
    return portal.identity_violations(delivered.select("portal_document_guid", "document_id", "title").distinct(), catalog)


@query
def raw_receipts(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "portal_records").withColumn("delivered_at", F.col("delivered_at").cast("timestamp"))
    return artifacts.first_receipts(raw, "payload", "delivered_at").select("content_sha256", F.date_format("retrieved_at", "yyyy-MM-dd HH:mm:ss").alias("retrieved_at"), "deliveries")


@query
def raw_new_contents(spark: SparkSession, d: str) -> DataFrame:
    """What the last file of each feed would add to the raw store of the files before."""
    raw = table(spark, d, "portal_records")
    last = raw.groupBy("feed").agg(F.max("file_no").alias("last"))
    placed = raw.join(last, "feed").select("payload", "delivered_at", (F.col("file_no") == F.col("last")).alias("is_last"))
    stored = artifacts.first_receipts(placed.where("not is_last"), "payload", "delivered_at")
    return artifacts.new_contents(placed.where("is_last"), stored, "payload").select("content_sha256", F.length("payload").cast("long").alias("chars"))


def _manifest(spark: SparkSession, d: str, back: int, columns: list[str]) -> DataFrame:
    """One row a document of the last snapshot (back 0) or one before: ids and hashes in the one form, the last delivery."""
    newest = F.row_number().over(Window.orderBy(F.desc("taken_at"), F.desc("snapshot_id")))  # one row a snapshot
    chosen = table(spark, d, "snapshots").select("snapshot_id", newest.alias("n")).where(F.col("n") == back + 1).select("snapshot_id")
    rows = table(spark, d, "manifest_entries").join(F.broadcast(chosen), "snapshot_id").withColumns({c: key_form(F.col(c)) for c in ("document_id", "content_sha256")})
    return snapshots.latest_rows(rows.where("document_id is not null"), ["snapshot_id", "document_id"], "delivered_at", columns)


@query
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of the last snapshot but one, brought up to the last: one row a document, under the last's name."""
    columns = ["content_sha256", "parser_version", "artifact_version"]
    before, last = _manifest(spark, d, 1, columns), _manifest(spark, d, 0, columns)
    both = artifacts.upsert(before.drop("snapshot_id"), last.drop("snapshot_id"), "document_id")
    name = last.select(F.max("snapshot_id")).scalar()
    return both.withColumn("artifact_version", F.coalesce("artifact_version", F.lit("1"))).withColumn("file", artifacts.file_component(F.concat_ws("__", "document_id", name)))


@query
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    hashed = table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("content_sha256")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc_id"))
    return hashed.where("documents > 1")


# text and hierarchy


@query
def status_and_type(spark: SparkSession, d: str) -> DataFrame:
    documents = _documents(spark, d)
    mapped = documents.select(portal.map_status(F.col("source_effect_status")).alias("status"), portal.document_type(F.col("document_id")).alias("document_type"))
    return mapped.groupBy("status", "document_type").agg(F.count("*").alias("documents"))


@query
def query_normalize(spark: SparkSession, d: str) -> DataFrame:
    return lexical.normalized_queries(_questions(spark, d), "question_id", "question")


@query
def token_lists(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(lexical.tokens(F.col("question")))
    return _questions(spark, d).select("question_id", F.array_join(words, " ").alias("tokens"), F.size(words).cast("long").alias("n_tokens"))


@query
def accent_fold(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("document_id", lexical.accent_fold(F.col("title")).alias("folded"))


@query
def reviewed_corrections(spark: SparkSession, d: str) -> DataFrame:
    """A correction that expects one 'Tp.' in every unit's text, and one on its result."""
    steps = F.array(*(F.struct(F.lit(a).alias("find"), F.lit(b).alias("replace"), F.lit(n).alias("expected_count")) for a, b, n in (("Tp.", "Thành phố", 1), ("Thành phố", "TP", 1))))
    fixed = normalize.corrected(F.col("text"), steps)
    return _units(spark, d).select("unit_id", F.size(fixed["wrong"]).cast("long").alias("wrong"), F.length(fixed["text"]).cast("long").alias("chars"))


def _portal_texts(spark: SparkSession, d: str) -> DataFrame:
    delivered, _ = portal.canonical_documents(table(spark, d, "portal_records"), "record_id", "payload")
    return delivered.select(F.concat_ws("#", "document_id", F.col("record_id").cast("string")).alias("document_id"), normalize.html_column(F.col("html")).alias("text"))


@query
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    return _portal_texts(spark, d)


@query
def parsed_units(spark: SparkSession, d: str) -> DataFrame:
    """Delivered HTML, normalized and parsed into units."""
    return hierarchy.parse_units(_portal_texts(spark, d), "document_id", "text").withColumn("path", F.array_join("path", " "))


@query
def parsed_unit_violations(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.unit_violations(cut(hierarchy.parse_units(_portal_texts(spark, d), "document_id", "text")))


@query
def reparsed_units(spark: SparkSession, d: str) -> DataFrame:
    """The stored units of each law written out as headed lines and parsed again: ids, parents and paths."""
    units = _units(spark, d)
    head = F.when(F.col("unit_type") == "chapter", F.concat(F.lit("Chương "), "number")).when(F.col("unit_type") == "article", F.concat(F.lit("Điều "), "number", F.lit("."))).when(F.col("unit_type") == "clause", F.concat(F.col("number"), F.lit(". nội dung"))).otherwise(F.concat(F.col("number"), F.lit(") nội dung")))
    # units stand in the order of their paths; numbers compare as numbers
    place = F.transform("path", lambda p: F.lpad(F.regexp_extract(p, r"::([^:]+)$", 1), 6, "0"))
    rooted = F.when(F.col("path")[0].contains("::chapter::"), place).otherwise(F.concat(F.array(F.lit("")), place))
    lines = units.select("document_id", F.struct(rooted.alias("place"), head.alias("line")).alias("x"))
    texts = lines.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))
    return hierarchy.parse_units(texts, "document_id", "text").select("unit_id", "document_id", "unit_type", "number", "parent_id", F.array_join("path", " ").alias("path"))


@query
def unit_violations(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.unit_violations(_units(spark, d))


# graph


@query
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(_documents(spark, d), _units(spark, d)).select("label", "key")


@query
def graph_node_properties(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(_documents(spark, d), _units(spark, d)).select("label", "key", F.explode("properties").alias("property", "value"))


@query
def repeated_node_keys(spark: SparkSession, d: str) -> DataFrame:
    return graph.repeated_nodes(graph.nodes(_documents(spark, d), _units(spark, d)))


@query
def amends_properties(spark: SparkSession, d: str) -> DataFrame:
    return graph.amendments(_documents(spark, d), _units(spark, d), _relations(spark, d)).select("relation_id", F.explode("properties").alias("property", "value"))


@query
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_documents(spark, d), _units(spark, d), _relations(spark, d)).select("type", "src", "dst")


@query
def hierarchy_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_documents(spark, d), _units(spark, d), _relations(spark, d)).where("type like 'HAS\\\\_%' and type not in ('HAS_TYPE', 'HAS_STATUS')").select("type", "src", "dst")


@query
def metadata_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_documents(spark, d), _units(spark, d), _relations(spark, d)).where("type in ('HAS_TYPE', 'HAS_STATUS', 'IN_FIELD', 'ISSUED_BY', 'SIGNED_BY')").select("type", "src", "dst", "extra")


@query
def amends_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.amends(_documents(spark, d), _units(spark, d), _relations(spark, d)).select("src", "dst", F.col("extra").alias("relation_id"))


@query
def graph_reconcile(spark: SparkSession, d: str) -> DataFrame:
    documents, units, relations = _documents(spark, d), _units(spark, d), _relations(spark, d)
    observed = graph.observed_counts(graph.nodes(documents, units), graph.edges(documents, units, relations))
    return graph.reconcile(graph.expected_counts(documents, units, relations), observed)


@query
def unit_counts(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).rollup("document_id", "unit_type").agg(F.count("*").alias("units"))


# integrity


@query
def relation_violations(spark: SparkSession, d: str) -> DataFrame:
    return integrity.relation_violations(_relations(spark, d), _documents(spark, d), _units(spark, d))


@query
def gold_violations(spark: SparkSession, d: str) -> DataFrame:
    return integrity.gold_violations(table(spark, d, "gold_questions"), _documents(spark, d), _units(spark, d))


@query
def gold_profile(spark: SparkSession, d: str) -> DataFrame:
    return integrity.gold_profile(table(spark, d, "gold_questions"))


@query
def document_violations(spark: SparkSession, d: str) -> DataFrame:
    return integrity.document_violations(table(spark, d, "legal_documents"))


@query
def manifest_violations(spark: SparkSession, d: str) -> DataFrame:
    last = _manifest(spark, d, 0, ["content_sha256", "portal_document_guid", "normalizer_version", "parser_version", "artifact_version"])
    parsed = _documents(spark, d).withColumns({c: key_form(F.col(c)) for c in ("document_id", "content_sha256")})
    return integrity.manifest_violations(last, parsed)


@query
def snapshot_violations(spark: SparkSession, d: str) -> DataFrame:
    """The last manifest against the portal's answers as raw store, their first receipts, and the parsed documents."""
    last = _manifest(spark, d, 0, ["content_sha256", "portal_document_guid", "normalizer_version", "parser_version", "artifact_version", "parsed_path"])
    parsed = _documents(spark, d).withColumns({c: key_form(F.col(c)) for c in ("document_id", "content_sha256")})
    delivered = table(spark, d, "portal_records").where("payload is not null")
    raw = delivered.select(F.sha2("payload", 256).alias("content_sha256"), "payload")
    receipts = artifacts.first_receipts(delivered, "payload", "delivered_at").select("content_sha256", F.date_format("retrieved_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("retrieved_at"))
    return integrity.snapshot_violations(last, raw, receipts, parsed)


@query
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Laws that only the unit table or only the last manifest names, by the one form of their ids."""
    named = _units(spark, d).select("document_id").distinct().select(key_form(F.col("document_id")).alias("document_id"))
    return integrity.key_set_difference(named, _manifest(spark, d, 0, ["content_sha256"]), "document_id")


@query
def snapshot_report(spark: SparkSession, d: str) -> DataFrame:
    return integrity.snapshot_report(_documents(spark, d), _units(spark, d))


@query
def metadata_presence(spark: SparkSession, d: str) -> DataFrame:
    return integrity.metadata_presence(_documents(spark, d))


@query
def effective_gold(spark: SparkSession, d: str) -> DataFrame:
    """Whether each question's laws are in force on the question's day."""
    asked = _questions(spark, d).select("question_id", "effective_at", F.explode("gold_document_ids").alias("document_id"))
    both = asked.join(_documents(spark, d).select("document_id", "effective_from", "effective_to", "status"), "document_id")
    return both.select("question_id", "document_id", integrity.effective(F.col("effective_from"), F.col("effective_to"), F.col("status"), F.col("effective_at")).alias("in_force"))


# retrieval


@query
def lexical_postings(spark: SparkSession, d: str) -> DataFrame:
    held = lexical.postings(_units(spark, d), "unit_id", "text").where("term is not null")
    return held.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"))


@query
def lexical_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.index_stats(lexical.postings(_units(spark, d), "unit_id", "text"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    asked = lexical.normalized_queries(_asked(spark, d), "question_id", "question")
    return lexical.bm25_topk_documents(asked, lexical.bags(_units(spark, d), "unit_id", "text"), 10)


@query
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).drop("document_id")


def _locator_texts(spark: SparkSession, d: str) -> DataFrame:
    """A question for each relation that names its target by document, article, clause and point, as the target's id has them."""
    part = lambda kind: F.nullif(F.regexp_extract("target.unit_id", rf"::{kind}::([^:]+)", 1), F.lit(""))
    words = [F.concat(F.lit(f"{label} "), part(kind)) for label, kind in (("điểm", "point"), ("khoản", "clause"), ("Điều", "article"))]
    return _relations(spark, d).where("target.unit_id is not null").select("relation_id", F.concat_ws(" ", F.lit("Nội dung"), *words, F.lit("của văn bản số"), "target.document_id").alias("text"))


@query
def locators(spark: SparkSession, d: str) -> DataFrame:
    return lexical.locators(lexical.normalized_queries(_locator_texts(spark, d), "relation_id", "text"))


@query
def exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = lexical.normalized_queries(_locator_texts(spark, d), "relation_id", "text")
    return lexical.exact_units(asked, _units(spark, d), _documents(spark, d))


@query
def exact_then_lexical(spark: SparkSession, d: str) -> DataFrame:
    asked = lexical.normalized_queries(_locator_texts(spark, d), "relation_id", "text")
    return lexical.search(asked, _units(spark, d), _documents(spark, d), 5)


@query
def search_results(spark: SparkSession, d: str) -> DataFrame:
    """Exact hits first, then lexical ones, with all that a reader of them needs."""
    return lexical.described(exact_then_lexical(spark, d), _units(spark, d), _documents(spark, d))


@query
def dense_validate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").groupBy(dense.valid_vector(F.col("embedding"), 64).alias("valid")).agg(F.count("*").alias("vectors"))


@query
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return dense.cosine_topk(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", 10)


@query
def dense_resume(spark: SparkSession, d: str) -> DataFrame:
    """Units whose text is to be embedded and that no stored dense ranking has seen."""
    inputs = dense.embedding_texts(_units(spark, d), _documents(spark, d)).select("unit_id")
    return dense.missing_embeddings(inputs, _candidates(spark, d).where("dense_score is not null"), "unit_id")


@query
def embedding_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Units to be embedded and those a stored dense ranking has seen, by snapshot."""
    return dense.coverage(_units(spark, d), _candidates(spark, d).where("dense_score is not null"))


@query
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return dense.embedding_texts(_units(spark, d), _documents(spark, d))


# evaluation


@query
def eval_cases(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluation_cases(_questions(spark, d), _ranking(spark, d))


@query
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evaluation_metrics(eval_cases(spark, d))


@query
def eval_valid_recall(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.valid_recall(_questions(spark, d), _ranking(spark, d), _units(spark, d), _documents(spark, d))


@query
def result_keys(spark: SparkSession, d: str) -> DataFrame:
    """Questions without stored candidates, and candidates of unknown questions."""
    return evaluation.result_keys(_questions(spark, d), _ranking(spark, d))


@query
def eval_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Lexical retrieval of the query set, scored: one row."""
    asked = _asked(spark, d)
    ranking = _found(spark, d).select("query_id", "unit_id", "document_id", F.col("lexical_rank").alias("rank"))
    return evaluation.evaluation_metrics(evaluation.evaluation_cases(asked, ranking))


@query
def eval_dense(spark: SparkSession, d: str) -> DataFrame:
    """Dense retrieval of vectors, with those of the same label as gold: how many of the first 10 share it."""
    vectors = table(spark, d, "embeddings").select("vec_id", "label")
    found = dense_topk(spark, d)
    own, other = vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")), vectors
    hits = found.join(own, "query_id").join(other, "vec_id").withColumn("hit", (F.col("label") == F.col("query_label")).cast("int"))
    return hits.groupBy("query_id").agg(F.sum("hit").alias("hits"), F.coalesce(F.max(F.when(F.col("hit") == 1, F.round(1.0 / F.col("dense_rank"), 6))), F.lit(0.0)).alias("reciprocal_rank"))


@query
def eval_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ndcg(_questions(spark, d), _ranking(spark, d))


@query
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    held = _candidates(spark, d)
    lists = [held.where(f"{c} is not null").groupBy(F.col("question_id").alias("query_id"), "unit_id").agg(F.min(c).alias("rank")) for c in ("lexical_rank", "dense_rank")]
    return evaluation.reciprocal_rank_fusion(lists)


@query
def evidence(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.evidence(_ranking(spark, d), 5, 2)


@query
def citation_faults(spark: SparkSession, d: str) -> DataFrame:
    """Gold units as citations: those that aren't among a question's evidence."""
    cited = _questions(spark, d).select(F.col("question_id").alias("query_id"), F.explode("gold_unit_ids").alias("unit_id"))
    return evaluation.citation_faults(cited, _units(spark, d), evidence(spark, d))


@query
def related_units(spark: SparkSession, d: str) -> DataFrame:
    seeds = _ranking(spark, d).where("rank = 1")
    links = _relations(spark, d).select(F.col("source.unit_id").alias("source_unit_id"), F.col("target.unit_id").alias("target_unit_id")).distinct()
    return evaluation.related_units(seeds, _units(spark, d), links, 5)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical retrieval scored against the gold set."""
    return eval_lexical(spark, sf_dir)
