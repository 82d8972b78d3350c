"""Dense retrieval: vector checks, normalization, exact cosine top-k, embedding texts and resumable encoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors sent to the tasks at once; more queries are searched block by block.
QUERY_BLOCK = 4096
# How a unit's place is written.
LABELS = {"part": "Phần", "chapter": "Chương", "section": "Mục", "article": "Điều", "clause": "Khoản", "point": "Điểm"}
DENSE_TYPES = ("article", "clause", "point")


def valid_vector(vector: Column, dimensions: int) -> Column:
    """True for a vector of that many finite numbers; false for others and null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def normalized(vector: Column) -> Column:
    """The vector at length 1, in doubles; a zero vector stays."""
    v = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)


def cosine_topk(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """The k nearest other vectors of each query by exact cosine: query_id, key, dense_score (6 digits), dense_rank.

    queries and vectors have key and vector. Queries go to all tasks in blocks of at most QUERY_BLOCK; a task keeps the
    best k of all its rows for each query and hands on only these, at its end. Null and zero vectors and those of another
    length than the query's have no score; a query never finds its own key; a key with several vectors counts by its
    best. Ties rank by key.
    """
    spark = vectors.sparkSession
    asked = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("vector")).dropDuplicates(["query_id"])
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    key_type = vectors.schema[key].dataType.simpleString()
    source = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    parts = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        block = spark.sparkContext.broadcast(_unit_rows(rows.column("query_id").combine_chunks(), rows.column("vector").combine_chunks()))

        def steps(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            best: dict[int, pd.DataFrame] = {}
            for batch in batches:
                for size, (keys, unit) in _unit_rows(batch.column("key"), batch.column("vector")).items():
                    if size in block.value:
                        best[size] = _better(best.get(size), *block.value[size], keys, unit, k)
            for found in best.values():
                yield pa.RecordBatch.from_pandas(found[["query_id", "key", "dense_score"]], preserve_index=False)

        parts.append(source.mapInArrow(steps, f"query_id {key_type}, key {key_type}, dense_score double"))
    every = reduce(DataFrame.unionByName, parts).groupBy("query_id", "key").agg(F.max("dense_score").alias("dense_score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dense_score"), "key"))
    return every.withColumn("dense_rank", rank).where(F.col("dense_rank") <= k).withColumnRenamed("key", key)


def _better(best: pd.DataFrame | None, ids: np.ndarray, queries: np.ndarray, keys: np.ndarray, unit: np.ndarray, k: int) -> pd.DataFrame:
    """The best k keys of each query among those so far and some new vectors: query, query_id, key, dense_score."""
    # what can be among the best: no worse than the k-th of these vectors (one more for the query's own key, and the repeats)
    scores = np.round(queries @ unit.T, 6)
    most = k + 1 + len(keys) - len(pd.unique(keys))
    least = np.partition(scores, len(keys) - most, axis=1)[:, len(keys) - most] if most < len(keys) else np.full(len(ids), -2.0)
    if best is not None:  # nor worse than the k-th so far
        full = best.groupby("query")["dense_score"].agg(["size", "min"])
        full = full[full["size"] == k]
        least[full.index] = np.maximum(least[full.index], full["min"])
    q, at = np.nonzero(scores >= least[:, None])
    new = pd.DataFrame({"query": q, "query_id": ids[q], "key": keys[at], "dense_score": scores[q, at]})
    every = pd.concat([best, new[new["query_id"] != new["key"]]]) if best is not None else new[new["query_id"] != new["key"]]
    ranked = every.sort_values(["query", "dense_score", "key"], ascending=[True, False, True], kind="stable").drop_duplicates(["query", "key"])
    return ranked.groupby("query").head(k)


def _unit_rows(keys: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys and unit vectors by dimension, without zero and non-finite ones."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes[sizes > 0]).astype(int):
        chosen = np.flatnonzero(sizes == size)
        rows = vectors.take(pa.array(chosen))
        m = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        length = np.sqrt((m * m).sum(axis=1))
        good = np.isfinite(length) & (length > 0)
        if good.any():
            own = keys.take(pa.array(chosen[good]))
            out[int(size)] = (own.to_numpy(zero_copy_only=False), m[good] / length[good, None])
    return out


def embedding_texts(units: DataFrame, documents: DataFrame) -> DataFrame:
    """unit_id, text to embed for articles, clauses and points: document title, place, title and text on lines.

    Units whose document or a unit of whose path is missing are left out (they are violations elsewhere).
    """
    wanted = units.where(F.col("unit_type").isin(*DENSE_TYPES)).select("unit_id", "document_id", "title", "text", "path")
    label = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    places = units.select(F.col("unit_id").alias("step"), F.concat_ws(" ", label[F.col("unit_type")], "number").alias("place"))
    steps = wanted.select("unit_id", F.size("path").alias("depth"), F.posexplode("path").alias("pos", "step")).join(places, "step")
    located = steps.groupBy("unit_id", "depth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "place"))), lambda x: x["place"]), " > ").alias("located"), F.count("*").alias("n")).where("n = depth")
    titles = documents.select("document_id", F.col("title").alias("document_title"))
    full = wanted.join(located.select("unit_id", "located"), "unit_id").join(titles, "document_id")
    return full.select("unit_id", F.concat_ws("\n", F.concat(F.lit("Văn bản: "), "document_title"), F.concat(F.lit("Vị trí: "), "located"), "title", "text").alias("text"))


def missing_embeddings(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs that have no vector yet."""
    return inputs.join(done.select(key), key, "left_anti")


def coverage(units: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per snapshot the units that are to be embedded and have a vector: snapshot_id, units, embedded, complete.

    vectors: unit_id (repeats count once). Snapshots with embedded over 0 own embeddings.
    """
    wanted = units.where(F.col("unit_type").isin(*DENSE_TYPES)).select("snapshot_id", "unit_id")
    both = wanted.join(vectors.select("unit_id").distinct().withColumn("there", F.lit(True)), "unit_id", "left")
    return both.groupBy("snapshot_id").agg(F.count("*").alias("units"), F.count("there").alias("embedded")).withColumn("complete", F.col("units") == F.col("embedded"))


def encode(inputs: DataFrame, key: str, text: str, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> DataFrame:
    """key and vector (length 1) of each text, batch (1 to 128) texts at a time.

    encoder() is called once a task and gives a function from texts to vectors; on what device it works is its affair.
    """
    if not 1 <= batch <= 128:
        raise ValueError("batch must be between 1 and 128")
    key_type = inputs.schema[key].dataType.simpleString()

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for rows in batches:
            texts = [x or "" for x in rows.column("text").to_pylist()]
            vectors = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([rows.column("key"), pa.array(vectors, pa.list_(pa.float64()))], names=["key", "vector"])

    made = inputs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(steps, f"key {key_type}, vector array<double>")
    return made.select(F.col("key").alias(key), normalized(F.col("vector")).alias("vector"))
