"""Node and edge tables of a snapshot, and the counts they are reconciled with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("part", "chapter", "section", "article", "clause", "point")
# Metadata node label, its edge type, and the column of documents it comes from.
SINGLE = {"DocumentType": ("HAS_TYPE", "portal_document_type"), "EffectStatus": ("HAS_STATUS", "source_effect_status")}
NODE_LABELS = ("Snapshot", "Document", "DocumentType", "EffectStatus", "Field", "Organization", "Signer", "Part", "Chapter", "Section", "Article", "Clause", "Point")
EDGE_TYPES = ("IN_SNAPSHOT", "HAS_TYPE", "HAS_STATUS", "IN_FIELD", "ISSUED_BY", "SIGNED_BY", "HAS_PART", "HAS_CHAPTER", "HAS_SECTION", "HAS_ARTICLE", "HAS_CLAUSE", "HAS_POINT", "AMENDS")


# Properties of document and unit nodes and of amendments.
DOCUMENT_PROPERTIES = (
    "document_id", "portal_document_guid", "title", "document_type", "portal_document_type", "issuer", "issued_date", "effective_from", "effective_to", "status",
    "source_effect_status", "source_url", "content_url", "content_sha256", "snapshot_id", "artifact_version", "parser_version",
)
UNIT_PROPERTIES = ("unit_id", "document_id", "unit_type", "number", "title", "text", "parent_id", "path", "snapshot_id")
AMENDMENT_PROPERTIES = ("relation_id", "amendment_type", "evidence_unit_id", "source_url", "raw_sha256", "provenance", "review_status", "reviewed_by", "reviewed_at", "snapshot_id", "note")


def _properties(table: DataFrame, names: tuple[str, ...]) -> Column:
    """Map of a row's properties as text, those that are null left out; a list is its parts with blanks between."""
    text = lambda c: F.array_join(c, " ") if dict(table.dtypes)[c].startswith("array") else F.col(c).cast("string")
    pairs = [x for c in names if c in table.columns for x in (F.lit(c), text(c))]
    every = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.map_filter(every, lambda _, v: v.isNotNull())


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def physical_key(snapshot: Column, key: Column) -> Column:
    """Key of a document or unit in its snapshot."""
    return F.concat_ws("::", snapshot, key)


def one_row_each(table: DataFrame, key: str, later: str | None = None) -> DataFrame:
    """Rows repeated under one key as one row: the latest by `later`, else whichever (they are equal)."""
    if later is None or later not in table.columns:
        return table.where(F.col(key).isNotNull()).dropDuplicates([key])
    others = [c for c in table.columns if c not in (key, later)]
    row = F.struct(*(F.col(c) for c in [later, *others]))
    return table.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, F.col(later)).alias("row")).select(*(F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in table.columns))


def _named(documents: DataFrame) -> DataFrame:
    """Every name of a document's metadata as listed: src, label, type, name, extra (which list it comes from, job title)."""
    none, text = F.lit(None).cast("string"), lambda c: F.coalesce(c, F.array().cast("array<string>"))

    def entry(label: str, kind: str, name: Column, extra: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(kind).alias("type"), name.alias("name"), extra.alias("extra"))

    lists = [F.array(*(entry(label, kind, F.col(column), none) for label, (kind, column) in SINGLE.items()))]
    lists.append(F.transform(text("fields"), lambda x: entry("Field", "IN_FIELD", x, F.lit("fields"))))
    lists.append(F.transform(text("majors"), lambda x: entry("Field", "IN_FIELD", x, F.lit("majors"))))
    lists.append(F.transform(text("issuing_organs"), lambda x: entry("Organization", "ISSUED_BY", x, none)))
    signers = F.coalesce(F.col("signers"), F.array().cast("array<struct<name:string,job_title:string>>"))
    lists.append(F.transform(signers, lambda s: entry("Signer", "SIGNED_BY", s["name"], s["job_title"])))
    every = documents.select(physical_key(F.col("snapshot_id"), F.col("document_id")).alias("src"), F.explode(F.concat(*lists)).alias("x"))
    return every.select("src", "x.*").where("src is not null and name is not null")


def _metadata(documents: DataFrame) -> DataFrame:
    """src, label, type, name and extra (field sources, a signer's job title) of every metadata edge, once each."""
    return _named(documents).groupBy("src", "label", "type", "name").agg(F.nullif(F.array_join(F.array_sort(F.collect_set("extra")), ","), F.lit("")).alias("sources"), F.max("extra").alias("job")).select(
        "src", "label", "type", "name", F.when(F.col("label") == "Signer", F.col("job")).otherwise(F.col("sources")).alias("extra")
    )


def nodes(documents: DataFrame, units: DataFrame) -> DataFrame:
    """label, key, document_id (null for metadata), properties. documents and units have one row a key (see one_row_each)."""
    none, named = F.lit(None).cast("string").alias("document_id"), lambda c: F.create_map(F.lit("name"), F.col(c)).alias("properties")
    parser = documents.select("snapshot_id", "document_id", "parser_version").distinct() if "parser_version" in documents.columns else None
    own = units.where(F.col("unit_type").isin(*TYPES))
    own = own if parser is None else own.join(parser, ["snapshot_id", "document_id"], "left")
    snapshot = documents.select("snapshot_id").union(units.select("snapshot_id")).where("snapshot_id is not null").distinct()
    return _union([
        snapshot.select(F.lit("Snapshot").alias("label"), F.col("snapshot_id").alias("key"), none, F.create_map(F.lit("snapshot_id"), F.col("snapshot_id")).alias("properties")),
        documents.select(F.lit("Document").alias("label"), physical_key(F.col("snapshot_id"), F.col("document_id")).alias("key"), "document_id", _properties(documents, DOCUMENT_PROPERTIES).alias("properties")),
        _metadata(documents).select("label", "name").distinct().select("label", F.col("name").alias("key"), none, named("name")),
        own.select(F.initcap("unit_type").alias("label"), physical_key(F.col("snapshot_id"), F.col("unit_id")).alias("key"), "document_id", _properties(own, (*UNIT_PROPERTIES, "parser_version")).alias("properties")),
    ])


def edges(documents: DataFrame, units: DataFrame, relations: DataFrame) -> DataFrame:
    """type, src, dst, extra. Children whose parent isn't there and relations whose ends aren't there have no edge."""
    doc, unit = physical_key(F.col("snapshot_id"), F.col("document_id")), physical_key(F.col("snapshot_id"), F.col("unit_id"))
    none = F.lit(None).cast("string").alias("extra")
    typed = units.where(F.col("unit_type").isin(*TYPES))
    member = [x.select(F.lit("IN_SNAPSHOT").alias("type"), key.alias("src"), F.col("snapshot_id").alias("dst"), none) for x, key in ((documents, doc), (typed, unit))]
    kind = F.concat(F.lit("HAS_"), F.upper("unit_type")).alias("type")
    roots = typed.where("parent_id is null").select(kind, doc.alias("src"), unit.alias("dst"), none)
    parents = units.select("snapshot_id", F.col("unit_id").alias("parent_id")).distinct()
    children = typed.where("parent_id is not null").join(parents, ["snapshot_id", "parent_id"], "left_semi").select(kind, physical_key(F.col("snapshot_id"), F.col("parent_id")).alias("src"), unit.alias("dst"), none)
    meta = _metadata(documents).select("type", "src", F.col("name").alias("dst"), "extra")
    return _union([*member, roots, children, meta, amends(documents, units, relations)])


def amends(documents: DataFrame, units: DataFrame, relations: DataFrame) -> DataFrame:
    """AMENDS edges between units, or documents where a relation names no unit."""
    ends = documents.select(physical_key(F.col("snapshot_id"), F.col("document_id")).alias("end")).unionByName(units.select(physical_key(F.col("snapshot_id"), F.col("unit_id")).alias("end"))).distinct()
    key = lambda side: physical_key(F.col("snapshot_id"), F.coalesce(f"{side}.unit_id", f"{side}.document_id"))
    wanted = relations.where("relation_type = 'AMENDS'").select(key("source").alias("src"), key("target").alias("dst"), F.col("relation_id").alias("extra")).distinct()
    found = wanted.join(ends.withColumnRenamed("end", "src"), "src", "left_semi").join(ends.withColumnRenamed("end", "dst"), "dst", "left_semi")
    return found.select(F.lit("AMENDS").alias("type"), "src", "dst", "extra")


def amendments(documents: DataFrame, units: DataFrame, relations: DataFrame) -> DataFrame:
    """src, dst, relation_id, properties of the AMENDS edges; a null note is no property."""
    known = relations.where("relation_type = 'AMENDS'").select("relation_id", _properties(relations, AMENDMENT_PROPERTIES).alias("properties")).dropDuplicates(["relation_id"])
    return amends(documents, units, relations).withColumnRenamed("extra", "relation_id").join(known, "relation_id").select("src", "dst", "relation_id", "properties")


def repeated_nodes(node_table: DataFrame) -> DataFrame:
    """label, key, nodes of keys that stand for more than one node of a label: every label has unique keys."""
    return node_table.groupBy("label", "key").agg(F.count("*").alias("nodes")).where("nodes > 1")


def expected_counts(documents: DataFrame, units: DataFrame, relations: DataFrame) -> DataFrame:
    """kind (node, edge), name, expected: what the source tables say, without building the graph."""
    unit_counts = units.agg(F.count_if(F.col("unit_type").isin(*TYPES)).alias("all"), *(F.count_if(F.col("unit_type") == t).alias(t) for t in TYPES))
    # the names of a document, its own row and its snapshot, listed once and counted by label
    own = documents.select(F.lit("Document").alias("label"), F.col("document_id").alias("name")).unionByName(units.select(F.lit("Snapshot").alias("label"), F.col("snapshot_id").alias("name")).distinct())
    own = own.unionByName(documents.select(F.lit("Snapshot").alias("label"), F.col("snapshot_id").alias("name")).distinct())
    edges_of = _named(documents).groupBy("src", "label", "name").count().select("label", "name")
    labels = own.unionByName(edges_of).groupBy("label").agg(F.count_distinct("name").alias("nodes"), F.count("*").alias("edges"))
    types = {"DocumentType": "HAS_TYPE", "EffectStatus": "HAS_STATUS", "Field": "IN_FIELD", "Organization": "ISSUED_BY", "Signer": "SIGNED_BY"}
    flat = labels.agg(*(F.coalesce(F.max(F.when(F.col("label") == x, F.col(c))), F.lit(0)).alias(f"{c}_{x}") for x in ("Document", "Snapshot", *types) for c in ("nodes", "edges")))
    amending = relations.where("relation_type = 'AMENDS'").agg(F.count_distinct("relation_id").alias("amends"))
    wide = unit_counts.join(flat, F.lit(True)).join(amending, F.lit(True))  # one row each
    rows = [("node", "Snapshot", "nodes_Snapshot"), ("node", "Document", "nodes_Document"), *(("node", x, f"nodes_{x}") for x in types), *(("node", t.capitalize(), t) for t in TYPES)]
    rows += [("edge", "IN_SNAPSHOT", "`all` + nodes_Document"), *(("edge", kind, f"edges_{x}") for x, kind in types.items()), *(("edge", f"HAS_{t.upper()}", t) for t in TYPES), ("edge", "AMENDS", "amends")]
    stacked = ", ".join(f"'{kind}', '{name}', {value}" for kind, name, value in rows)
    return wide.select(F.expr(f"stack({len(rows)}, {stacked}) as (kind, name, expected)"))


def observed_counts(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """kind, name, actual."""
    return node_table.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("actual")).select(F.lit("node").alias("kind"), "name", "actual").unionByName(
        edge_table.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("actual")).select(F.lit("edge").alias("kind"), "name", "actual")
    )


def reconcile(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """kind, name, expected, actual, matches; a kind that only one side has counts 0 on the other."""
    both = expected.join(observed, ["kind", "name"], "full_outer").na.fill(0, ["expected", "actual"])
    return both.select("kind", "name", "expected", "actual", (F.col("expected") == F.col("actual")).alias("matches"))
