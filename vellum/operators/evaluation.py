"""Scoring rankings against gold sets, fusing rankings, and citations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.integrity import effective

DEPTHS = (1, 3, 5, 10)


def ranked_lists(ranking: DataFrame) -> DataFrame:
    """Per query its units and their documents in rank order (a ranking is at most 50 deep): query_id, units, documents."""
    best = ranking.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "unit_id", "document_id"))).alias("list"))
    return best.select("query_id", F.transform("list", lambda x: x["unit_id"]).alias("ranked_units"), F.transform("list", lambda x: x["document_id"]).alias("ranked_documents"))


def evaluation_cases(questions: DataFrame, ranking: DataFrame) -> DataFrame:
    """One row per question: recall at 1, 3, 5, 10 for units and documents, reciprocal rank within 10, status.

    questions: question_id, gold_unit_ids, gold_document_ids; ranking: query_id, unit_id, document_id, rank. A question
    without results misses; questions with an empty or null gold set are left out (they can't be scored); documents are
    counted over the same first units, repeats taking places.
    """
    gold = questions.where("size(gold_unit_ids) > 0 and size(gold_document_ids) > 0").select("question_id", F.array_distinct("gold_unit_ids").alias("gold_units"), F.array_distinct("gold_document_ids").alias("gold_documents"))
    empty = F.array().cast("array<string>")
    both = gold.join(ranked_lists(ranking), F.col("question_id") == F.col("query_id"), "left").select("question_id", "gold_units", "gold_documents", F.coalesce("ranked_units", empty).alias("units"), F.coalesce("ranked_documents", empty).alias("documents"))
    recall = [
        (F.size(F.array_intersect(f"gold_{kind}", F.slice(kind, 1, k))) / F.size(f"gold_{kind}")).alias(f"{kind[:-1]}_recall_{k}")
        for kind in ("units", "documents")
        for k in DEPTHS
    ]
    first = F.array_min(F.filter(F.transform("gold_units", lambda u: F.array_position(F.slice(F.col("units"), 1, 10), u)), lambda p: p > 0))
    hits = F.size(F.array_intersect("gold_units", F.slice("units", 1, 10)))
    status = F.when(hits == F.size("gold_units"), "full_hit").when(hits > 0, "partial_hit").otherwise("miss")
    return both.select("question_id", *recall, F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"), status.alias("status"))


def evaluation_metrics(cases: DataFrame) -> DataFrame:
    """One row: macro recalls, MRR at 10 and counts of full hits, partial hits and misses."""
    means = [F.round(F.avg(f"{kind}_recall_{k}"), 9).alias(f"{kind}_recall_{k}") for kind in ("unit", "document") for k in DEPTHS]
    return cases.agg(F.count("*").alias("questions"), *means, F.round(F.avg("reciprocal_rank"), 9).alias("mrr_10"), *(F.count_if(F.col("status") == s).alias(s) for s in ("full_hit", "partial_hit", "miss")))


def ndcg(questions: DataFrame, ranking: DataFrame, depth: int = 10) -> DataFrame:
    """Per question the normalized discounted gain of its first units: question_id, ndcg. 0 without hits."""
    gold = questions.where("size(gold_unit_ids) > 0").select("question_id", F.explode(F.array_distinct("gold_unit_ids")).alias("unit_id"))
    size = gold.groupBy("question_id").count()
    gains = gold.join(ranking.where(F.col("rank") <= depth).select(F.col("query_id").alias("question_id"), "unit_id", "rank"), ["question_id", "unit_id"]).groupBy("question_id").agg(F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("gain"))
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("count").cast("int"), F.lit(depth))), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
    return size.join(gains, "question_id", "left").select("question_id", F.round(F.coalesce("gain", F.lit(0.0)) / best, 6).alias("ndcg"))


def valid_recall(questions: DataFrame, ranking: DataFrame, units: DataFrame, documents: DataFrame, depth: int = 10) -> DataFrame:
    """Recall over gold units whose document is in force on the question's day: question_id, in_force, recall.

    recall is null where no gold unit is in force; a question without a gold unit that exists has no row.
    """
    gold = questions.where("size(gold_unit_ids) > 0").select("question_id", "effective_at", F.explode(F.array_distinct("gold_unit_ids")).alias("unit_id"))
    owned = gold.join(units.select("unit_id", "document_id"), "unit_id").join(documents.select("document_id", "effective_from", "effective_to", "status"), "document_id")
    valid = owned.withColumn("valid", effective(F.col("effective_from"), F.col("effective_to"), F.col("status"), F.col("effective_at")) == "true")
    found = ranking.where(F.col("rank") <= depth).select(F.col("query_id").alias("question_id"), "unit_id", F.lit(True).alias("hit")).distinct()
    both = valid.join(found, ["question_id", "unit_id"], "left").groupBy("question_id").agg(F.count_if("valid").alias("in_force"), F.count_if(F.col("valid") & F.coalesce("hit", F.lit(False))).alias("hits"))
    return both.select("question_id", "in_force", F.when(F.col("in_force") > 0, F.round(F.col("hits") / F.col("in_force"), 9)).alias("recall"))


def result_keys(questions: DataFrame, ranking: DataFrame) -> DataFrame:
    """question_id, code where questions and results don't have the same keys: NO_RESULT, UNKNOWN_QUESTION."""
    asked = questions.select("question_id").distinct().withColumn("asked", F.lit(True))
    ranked = ranking.select(F.col("query_id").alias("question_id")).distinct().withColumn("ranked", F.lit(True))
    code = F.when(F.col("ranked").isNull(), "NO_RESULT").when(F.col("asked").isNull(), "UNKNOWN_QUESTION")
    return asked.join(ranked, "question_id", "full_outer").select("question_id", code.alias("code")).where("code is not null")


def content_digest(table: DataFrame) -> DataFrame:
    """One row, digest: a hash of all rows whatever their order, in sums of fixed size (equal rows count each)."""
    row = F.sha2(F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"}), 256)
    sums = [F.coalesce(F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long")), F.lit(0)) for i in range(8)]
    return table.agg(F.sha2(F.concat_ws(",", F.count("*"), *sums), 256).alias("digest"))


def run_record(name: str, metrics: DataFrame, gold: DataFrame, snapshot: str | None, split: str | None, config: dict, commit: str | None) -> DataFrame:
    """One row for a retrieval run: run_id, its provenance (snapshot, split, gold_sha256, git_commit, created_at, config) and metrics.

    The id depends on what was asked of what (name, snapshot, split, gold set, config), not on when.
    """
    base = metrics.withColumn("gold_sha256", content_digest(gold).scalar())
    told = base.withColumns({"snapshot_id": F.lit(snapshot), "split": F.lit(split), "config": F.lit(json.dumps(config, sort_keys=True)), "git_commit": F.lit(commit), "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")})
    digest = F.sha2(F.concat_ws("|", F.lit(name), F.coalesce("snapshot_id", F.lit("")), F.coalesce("split", F.lit("")), "gold_sha256", "config"), 256)
    return told.withColumn("run_id", F.concat(F.lit(f"{name}-"), F.substring(digest, 1, 12)))


def reciprocal_rank_fusion(rankings: list[DataFrame], constant: float = 60.0, depth: int = 10) -> DataFrame:
    """Fused ranking: query_id, unit_id, rrf_score, rank. Each ranking has query_id, unit_id, rank; constant is a parameter."""
    every = rankings[0].select("query_id", "unit_id", "rank")
    for other in rankings[1:]:
        every = every.unionByName(other.select("query_id", "unit_id", "rank"))
    scored = every.where("rank is not null").groupBy("query_id", "unit_id").agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 9).alias("rrf_score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "unit_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= depth)


def evidence(ranking: DataFrame, most: int = 10, per_document: int = 3) -> DataFrame:
    """The first units of each query with at most per_document of one document: query_id, unit_id, document_id, rank, place."""
    inside = F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("rank", "unit_id"))
    kept = ranking.withColumn("inside", inside).where(F.col("inside") <= per_document)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "unit_id"))
    return kept.withColumn("place", place).where(F.col("place") <= most).select("query_id", "unit_id", "document_id", "rank", "place")


def citation_faults(citations: DataFrame, units: DataFrame, shown: DataFrame) -> DataFrame:
    """Citations (query_id, unit_id) that name no unit (UNKNOWN) or one that was not shown as evidence (NOT_SHOWN)."""
    known = citations.select("query_id", "unit_id").distinct().join(units.select("unit_id", F.lit(True).alias("known")).distinct(), "unit_id", "left")
    seen = known.join(shown.select("query_id", "unit_id", F.lit(True).alias("shown")).distinct(), ["query_id", "unit_id"], "left")
    return seen.select("query_id", "unit_id", F.when(F.col("known").isNull(), "UNKNOWN").when(F.col("shown").isNull(), "NOT_SHOWN").alias("code")).where("code is not null")


def related_units(seeds: DataFrame, units: DataFrame, amends: DataFrame, most: int = 5) -> DataFrame:
    """Neighbours of seed units, one step and bounded: query_id, unit_id, via, related_id (parent, child, sibling, amends).

    seeds: query_id, unit_id; amends: source_unit_id, target_unit_id. At most `most` of each kind, by related_id.
    """
    tree = units.select("unit_id", "parent_id").distinct()
    own = seeds.select("query_id", "unit_id").distinct().join(tree, "unit_id", "left")
    up = own.where("parent_id is not null").select("query_id", "unit_id", F.lit("parent").alias("via"), F.col("parent_id").alias("related_id"))
    kids = tree.where("parent_id is not null").select(F.col("unit_id").alias("related_id"), "parent_id")
    down = own.drop("parent_id").join(kids, F.col("unit_id") == kids["parent_id"]).select("query_id", "unit_id", F.lit("child").alias("via"), "related_id")
    side = own.join(kids, "parent_id").where("related_id <> unit_id").select("query_id", "unit_id", F.lit("sibling").alias("via"), "related_id")
    links = amends.where("source_unit_id is not null and target_unit_id is not null")
    both = links.select(F.col("source_unit_id").alias("unit_id"), F.col("target_unit_id").alias("related_id")).unionByName(links.select(F.col("target_unit_id").alias("unit_id"), F.col("source_unit_id").alias("related_id")))
    across = own.drop("parent_id").join(both, "unit_id").select("query_id", "unit_id", F.lit("amends").alias("via"), "related_id")
    every = up.unionByName(down).unionByName(side).unionByName(across).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id", "unit_id", "via").orderBy("related_id"))
    return every.withColumn("n", rank).where(F.col("n") <= most).drop("n")
