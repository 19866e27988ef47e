"""Exact top-k search: tiles of queries and shards multiplied as matrices, the best of each tile kept, lists merged as a tree."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import Scratch
from tidewire.sources.files import located

#: Rows of a tile of queries and of a shard, components of either, and scores worked out at once.
QUERY_BLOCK, SHARD = 2048, 131_072
TILE_COMPONENTS, SHARD_COMPONENTS = 1 << 20, 1 << 24
PIECE, _CELLS = 16_384, 1 << 22
FAN_IN = 16
#: Rows that make a task of their own worth while when there are fewer shards than cores.
TASK_ROWS = 1024
_EXACT_FLOAT, _EXACT_DOUBLE, _LONG = 2**24, 2**53, 2**63 - 1


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; null if the vector or a component is null or not finite. What is beyond
    the range of a long counts as its nearest long."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(wide, lambda x: F.floor(x * scale)))


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.max())), abs(int(values.min())))


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floats or doubles while every partial sum is exact in them, else in longs or Python's
    integers. A product beyond +-(2^63 - 1) counts as that."""
    if not queries.size or not rows.size:
        return np.zeros((len(queries), len(rows)), np.int64)
    most = _largest(queries) * _largest(rows) * queries.shape[1]
    if most < _EXACT_DOUBLE:
        kind = np.float32 if most < _EXACT_FLOAT else np.float64
        return (queries.astype(kind) @ rows.T.astype(kind)).astype(np.int64)
    if most <= _LONG:
        return queries.astype(np.int64) @ rows.T.astype(np.int64)
    wide = queries.astype(object) @ rows.T.astype(object)
    return np.clip(wide, -_LONG, _LONG).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each row, ``ids`` ascending: higher scores first, then smaller ids."""
    count = scores.shape[1]
    if count > k:
        # Everything above the k-th best score belongs; among equals the first ones by id.
        edge = np.partition(scores, count - k, axis=1)[:, count - k, None]
        above, equal = scores > edge, scores == edge
        room = k - above.sum(axis=1, keepdims=True)
        chosen = np.nonzero(above | equal & (np.cumsum(equal, axis=1) <= room))[1].reshape(len(scores), k)
    else:
        chosen = np.broadcast_to(np.arange(count), scores.shape)
    order = np.argsort(-np.take_along_axis(scores, chosen, 1), axis=1, kind="stable")
    return np.take_along_axis(chosen, order, 1)


def _tile(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int):
    """(query_id, vec_id, score) of the best of one tile, ``rows`` by id; a query's own id is no candidate."""
    (query_ids, q), (ids, v) = queries, rows
    step = max(1, _CELLS // max(1, len(ids)))
    for at in range(0, len(query_ids), step):
        mine, scores = query_ids[at:at + step], _products(q[at:at + step], v)
        own = ids[None, :] == mine[:, None]
        if own.any():
            # Own rows are taken out of the choice: k more are chosen, then they are dropped.
            best = _best(scores, ids, k + int(own.sum(axis=1).max()))
            keep = ~np.take_along_axis(own, best, 1)
            keep &= np.cumsum(keep, axis=1) <= k
        else:
            best = _best(scores, ids, k)
            keep = np.ones(best.shape, bool)
        yield np.repeat(mine, keep.sum(axis=1)), ids[best[keep]], np.take_along_axis(scores, best, 1)[keep]


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query out of several lists."""
    query, vec, score = (np.concatenate(column) for column in zip(*parts))
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, bool)
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
    return query[rank < k], vec[rank < k], score[rank < k]


def _by_size(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, ids, matrix) of the vectors of each length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    starts, ids = np.cumsum(sizes, dtype=np.int64) - sizes, ids.to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        mine = sizes == size
        yield size, ids[mine], flat[starts[mine][:, None] + np.arange(size)]


def _packed(asking: DataFrame, blocks: int, kind: str) -> DataFrame:
    """A row for each tile of queries of one length: size, ids and components as bytes of fixed width."""
    placed = asking.select(F.size("v").alias("size"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")

    def pack(rows: pa.Table) -> pa.Table:
        ((size, ids, matrix),) = _by_size(rows.column("id").combine_chunks(), rows.column("v").combine_chunks())
        return pa.table({"size": pa.array([size], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "v": [matrix.astype(kind).tobytes()]})

    return placed.groupBy("size", "block").applyInArrow(pack, "size int, ids binary, v binary")


def _tiles(files: list[str], kind: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The written tiles, one in memory at a time."""
    for file in files:
        system, inner = located(file)
        with system.open_input_file(inner) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1):
                for size, ids, components in zip(*[column.to_pylist() for column in batch.columns]):
                    ids = np.frombuffer(ids, "<i8")
                    yield size, ids, np.frombuffer(components, kind).reshape(len(ids), size)


def _searched(held: dict[int, list], files: list[str], kind: str, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The local lists of one shard: every tile is taken past all rows of its length."""
    shard = {}
    for size, parts in held.items():
        ids, matrix = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(ids, kind="stable")
        shard[size] = ids[order], matrix[order]
    for size, query_ids, queries in _tiles(files, kind):
        if size in shard:
            ids, matrix = shard[size]
            yield _merged([part for at in range(0, len(ids), PIECE)
                           for part in _tile((query_ids, queries), (ids[at:at + PIECE], matrix[at:at + PIECE]), k)], k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
          scale: int = 256, query_block: int = QUERY_BLOCK, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every query by integer inner product, ties to the smaller id.

    Queries are written once, as tiles of bounded size, under the shared folder. All rows are dealt evenly over tasks, each vector
    once; a task holds a shard of bounded size and reads the tiles one after the other. It gives k rows a query; lists of up to
    ``FAN_IN`` shards are merged until one is left. Components travel and rest in as few bytes as the largest of them needs.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Vectors are only
    compared with those of their own length. Rows that repeat an id are candidates each, except for queries of that id; repeated
    queries are one query, of all its vectors the smallest. Components and scores beyond a long count as the nearest one, scores
    at least -(2^63 - 1). Fewer candidates than k are all returned; no queries, no rows. Other columns do not matter.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[key].cast("long").alias("id"), quantized(vectors[vector], scale).alias("v"), is_query.alias("is_query"))
    rows = rows.where("id is not null and v is not null")
    width, asks = F.size("v"), F.col("is_query")
    total, cells, asked, asked_cells, most = rows.agg(
        F.count("*"), F.sum(width), F.count(F.when(asks, 1)), F.sum(F.when(asks, width)),
        F.max(F.greatest(F.array_max("v"), -(F.array_min("v") + 1)))).first()
    bits = next(bits for bits in (16, 32, 64) if (most or 0) < 1 << bits - 1)
    kind, compact = f"<i{bits // 8}", F.col("v").cast(f"array<{ {16: 'smallint', 32: 'int', 64: 'bigint'}[bits]}>").alias("v")
    blocks = max(1, ceil(asked / query_block), ceil((asked_cells or 0) / TILE_COMPONENTS))
    shards = max(1, ceil(total / shard), ceil((cells or 0) / SHARD_COMPONENTS), min(spark.sparkContext.defaultParallelism, ceil(total / TASK_ROWS)))
    asking = rows.where(asks).select("id", compact).groupBy("id").agg(F.min("v").alias("v"))
    files = [unquote(file) for file in Scratch(spark, "queries").keep(_packed(asking, blocks, kind)).inputFiles()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()

        def lists(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
            for columns in _searched(held, files, kind, k):
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(len(columns[0]), place, np.int32))],
                                                 ["query_id", "vec_id", "score", "shard"])

        held, count = {}, 0
        for batch in batches:
            for size, ids, matrix in _by_size(batch.column(0), batch.column(1)):
                held.setdefault(size, []).append((ids, matrix))
                count += max(matrix.size, len(ids) * SHARD_COMPONENTS // SHARD)
            if count >= 2 * SHARD_COMPONENTS:
                yield from lists(held)
                held, count = {}, 0
        yield from lists(held)

    best = rows.select("id", compact).repartition(shards).mapInArrow(run, "query_id long, vec_id long, score long, shard int")
    merged = Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id")
    while True:
        best = best.withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("int"))
        best = best.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k)
        shards = ceil(shards / FAN_IN)
        if shards == 1:
            return best.select("query_id", "rank", "vec_id", "score")
        best = best.drop("rank")
