"""Exact nearest neighbours by cosine distance, in Arrow blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from lodestone.session import for_workers

#: Query vectors that are compared in one pass over the vectors.
QUERIES_PER_PASS = 4096


def _blocks(queries: DataFrame, query_id: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    ids, rows = [], []
    for r in queries.select(query_id, vector).where(f"{vector} IS NOT NULL").toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == QUERIES_PER_PASS:
            yield ids, np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, np.float64)


def _distances(unit: np.ndarray, vectors: pa.Array, n: int) -> np.ndarray:
    """Cosine distances of unit query vectors (rows) to the vectors of a batch (columns)."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    norm = np.linalg.norm(x, axis=1)
    return 1.0 - unit @ (x / np.where(norm > 0, norm, 1.0)[:, None]).T


def _kept(q: np.ndarray, d: np.ndarray, v: np.ndarray, keep: int, count: int) -> tuple[np.ndarray, ...]:
    """The ``keep`` best rows of each query, and each query's greatest distance still of use."""
    order = np.lexsort((v, d, q))
    q, d, v = q[order], d[order], v[order]
    first = np.searchsorted(q, np.arange(count))
    at = np.flatnonzero(np.arange(len(q)) - first[q] < keep)
    q, d, v = q[at], d[at], v[at]
    sizes = np.bincount(q, minlength=count)
    bound = np.full(count, np.inf)
    full = np.flatnonzero(sizes == keep)
    bound[full] = d[np.cumsum(sizes)[full] - 1]
    return q, d, v, bound


@for_workers
def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    vector_id: str = "vec_id",
    vector: str = "embedding",
    exclude_self: bool = False,
) -> DataFrame:
    """query_id, vec_id, distance, rank: the k nearest vectors of each query, rank from 1.

    The query set goes to the workers in blocks of bounded size; vectors are never shuffled.
    Each task keeps its k best per query, and only those are ranked. Ties go to the smaller
    id. Null vectors take no part; a zero vector has distance 1 from everything.
    """
    spark = vectors.sparkSession
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    q_type = queries.schema[query_id].dataType
    q_kind, q_arrow = q_type.simpleString(), to_arrow_type(q_type)
    rows = vectors.select(F.col(vector_id).alias("v"), F.col(vector).cast("array<double>").alias("e")).where("e IS NOT NULL")
    schema = f"query_id {q_kind}, vec_id {kind[vector_id]}, distance double"
    out = None
    for ids, matrix in _blocks(queries, query_id, vector):
        norms = np.linalg.norm(matrix, axis=1)
        sent = spark.sparkContext.broadcast((ids, matrix / np.where(norms > 0, norms, 1.0)[:, None]))

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, unit = sent.value
            keep = k + exclude_self
            held: tuple[np.ndarray, ...] = ()
            v_type = None
            for b in batches:
                if not b.num_rows:
                    continue
                v_type = b.schema.field(0).type
                d, v = _distances(unit, b.column(1), b.num_rows), b.column(0).to_numpy(zero_copy_only=False)
                if d.shape[1] > keep:
                    limit = np.partition(d, keep - 1, axis=1)[:, keep - 1]
                    if held:  # nothing beyond what is held already need be looked at
                        limit = np.minimum(limit, held[3])
                    q, at = np.nonzero(d <= limit[:, None])
                else:
                    q, at = (x.ravel() for x in np.indices(d.shape))
                found = (q, d[q, at], v[at])
                if held:
                    found = tuple(np.concatenate(x) for x in zip(held[:3], found))
                held = _kept(*found, keep, len(names))
            if held:
                q, d, v = held[:3]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, q_arrow).take(pa.array(q)), pa.array(v, v_type), pa.array(d)], names=["query_id", "vec_id", "distance"]
                )

        part = rows.mapInArrow(best, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema + ", rank long")
    if exclude_self:
        out = out.where("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def cosine_similarity(a, b):
    """Cosine similarity of two array columns, in double precision."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b))


@for_workers
def nearest_within(queries: DataFrame, vectors: DataFrame, *, query_id: str, vector_id: str, group: str, vector: str = "embedding") -> DataFrame:
    """query_id, compared, distance: how many vectors of its own group each query was compared
    with, and the least distance. A query's own vector (the same id) does not count; queries
    whose group holds nothing else have no row. Both sides have the group; nulls take no part.

    Queries go to the workers in blocks of bounded size and meet the vectors where they lie:
    a group of any size is spread over all tasks, and a number and a minimum per query and task
    is all that is shuffled.
    """
    q = queries.where(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(query_id, group, F.col(vector).cast("array<double>").alias("e"))
    rows = vectors.where(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(vector_id, group, F.col(vector).cast("array<double>").alias("e"))
    q_type = queries.schema[query_id].dataType
    q_arrow, schema = to_arrow_type(q_type), f"query_id {q_type.simpleString()}, compared long, distance double"
    out = None
    held: list = []

    def searched(block: list) -> DataFrame:
        matrix = np.array([r[2] for r in block], np.float64)
        norm = np.linalg.norm(matrix, axis=1)
        sent = rows.sparkSession.sparkContext.broadcast(([r[0] for r in block], [r[1] for r in block], matrix / np.where(norm > 0, norm, 1.0)[:, None]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, groups, unit = sent.value
            of: dict[object, list[int]] = {}
            for i, g in enumerate(groups):
                of.setdefault(g, []).append(i)
            number, least = np.zeros(len(ids), np.int64), np.full(len(ids), np.inf)
            for b in batches:
                spots: dict[object, list[int]] = {}
                for j, g in enumerate(b.column(1).to_pylist()):
                    if g in of:
                        spots.setdefault(g, []).append(j)
                for g, at in spots.items():
                    part = b.take(pa.array(at))
                    names = part.column(0).to_pylist()
                    mine = np.array(of[g])
                    d = _distances(unit[mine], part.column(2), len(at))
                    own = np.array([[n == ids[i] for n in names] for i in mine])
                    d = np.where(own, np.inf, d)
                    number[mine] += (~own).sum(axis=1)
                    least[mine] = np.minimum(least[mine], d.min(axis=1))
            hit = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in hit], q_arrow), pa.array(number[hit]), pa.array(least[hit])], names=["query_id", "compared", "distance"]
            )

        return rows.mapInArrow(run, schema)

    for r in q.toLocalIterator():
        held.append(r)
        if len(held) == QUERIES_PER_PASS:
            part, held = searched(held), []
            out = part if out is None else out.unionByName(part)
    if held:
        out = searched(held) if out is None else out.unionByName(searched(held))
    if out is None:
        return rows.sparkSession.createDataFrame([], schema)
    return out.groupBy("query_id").agg(F.sum("compared").alias("compared"), F.min("distance").alias("distance"))
