"""Vectors in blocks: a stated set of queries against all rows, tile by tile, with bounded heaps merging the tiles."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.common import cut, small

#: Rows of a block of candidates and of a block of queries, about.
ROWS, QUERIES = 8192, 1024
#: Components of a block at most, so that blocks of long vectors hold fewer rows.
COMPONENTS = 1 << 20
#: Different lengths of vectors whose counts may be broadcast; more are joined by a shuffle.
LENGTHS = 10_000


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """``id, v`` (array of double) of rows whose vector and components are neither null nor non-finite; equal rows once."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if nonzero:
        fine = fine & F.exists(v, lambda x: x != 0)
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).distinct()


def _blocks(rows: DataFrame, size: Column, count: Column, name: str) -> DataFrame:
    """Rows packed into blocks by a hash of their id: dim, block number, ids and vectors."""
    number = F.pmod(F.xxhash64("id", F.lit(11)), F.ceil(count / size))
    return rows.withColumn(name, number).groupBy("dim", name).agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("rows")).select("dim", name, F.col("rows.id").alias("ids"), F.col("rows.v").alias("vs"))


def tiles(vectors: DataFrame, is_query: Column, most: tuple[int, int, int] = (ROWS, QUERIES, COMPONENTS)) -> DataFrame:
    """Every block of queries next to every block of candidates of the same dimension: ``q_ids, q_vs, c_ids, c_vs``.

    A query block is repeated for each candidate block and meets it by an equality of block numbers. ``most``: rows and
    queries of a block, and its components, about.
    """
    rows = cut(vectors.withColumn("dim", F.size("v")))
    counts = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("nq")).where("nq > 0")
    counts = small(cut(counts), LENGTHS)
    rows = rows.join(counts, "dim")
    limit = lambda n: F.greatest(F.lit(1), F.least(F.lit(n), F.floor(F.lit(most[2]) / F.col("dim"))))
    size = limit(most[0])
    made = _blocks(rows.where(is_query), limit(most[1]), F.col("nq"), "qb")
    made = made.join(counts, "dim").withColumn("cb", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / size) - 1).cast("int"))))
    made = made.select("dim", F.col("cb").cast("long").alias("cb"), F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
    others = _blocks(rows, size, F.col("n"), "cb").select("dim", F.col("cb").cast("long").alias("cb"), F.col("ids").alias("c_ids"), F.col("vs").alias("c_vs"))
    return made.join(others, ["dim", "cb"]).select("q_ids", "q_vs", "c_ids", "c_vs")


def power_above(x: np.ndarray) -> float:
    """A power of two above all sizes of an array, so that dividing by it is exact and no square overflows."""
    return 2.0 ** int(np.clip(np.frexp(np.abs(x).max(initial=0.0))[1], -1000, 1000))


def _matrix(column: pa.ListArray, k: int) -> np.ndarray:
    inner = column[k].values
    return np.asarray(inner.flatten()).reshape(len(inner), -1)


def best(tiled: DataFrame, search: Callable, k: int, descending: bool, kind: str) -> DataFrame:
    """Each query's k best of all tiles: ``query_id, rank, vec_id, score``; ties go to the smaller vec_id.

    search(q, c_ids, c, own): for queries q, yields per query the positions and scores of at least its k best
    candidates of the tile; ``own`` are the queries' ids, which must be passed over. Whole scores may have any size: beyond
    64 bits they go to the merging in full, as text.
    """
    arrow = pa.int64() if kind == "long" else pa.float64()
    sign = -1 if descending else 1
    least, largest = -(1 << 63), (1 << 63) - 1

    def scan(batches):
        for batch in batches:
            for t in range(len(batch)):
                q_ids, c_ids = (np.asarray(batch.column(i)[t].values) for i in (0, 2))
                a, b, s, big = [], [], [], []
                for own, (at, score) in zip(q_ids, search(_matrix(batch.column(1), t), c_ids, _matrix(batch.column(3), t), q_ids), strict=True):
                    if score.dtype == object:
                        order = sorted(range(len(at)), key=lambda i: (sign * score[i], c_ids[at[i]]))[:k]
                        big += [None if least <= x <= largest else str(x) for x in score[order]]
                        score = np.array([min(max(x, least), largest) for x in score], np.int64)
                    else:
                        order = np.lexsort((c_ids[at], sign * score))[:k]
                        big += [None] * len(order)
                    a.append(np.full(len(order), own))
                    b.append(c_ids[at][order])
                    s.append(score[order])
                columns = [pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(s), arrow), pa.array(big, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "big"])

    def merge(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            for q, v, s, big in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heap = heaps.setdefault(q, [])
                item = (-sign * (s if big is None else int(big)), -v)
                if len(heap) < k:
                    heapq.heappush(heap, item)
                else:
                    heapq.heappushpop(heap, item)
        out = [(q, r + 1, -v, -sign * s) for q, heap in heaps.items() for r, (s, v) in enumerate(sorted(heap, reverse=True))]
        if out:
            q, r, v, s = zip(*out, strict=True)
            s = [min(max(x, least), largest) for x in s] if kind == "long" else s
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int32()), pa.array(v, pa.int64()), pa.array(s, arrow)], names=["query_id", "rank", "vec_id", "score"])

    found = tiled.mapInArrow(scan, f"query_id long, vec_id long, score {kind}, big string")
    return found.repartition("query_id").mapInArrow(merge, f"query_id long, rank int, vec_id long, score {kind}")
