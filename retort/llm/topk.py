"""Exact top-k by inner product of quantised vectors, score at a time over an impact-ordered index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.common import documents
from retort.llm.vectors import best, power_above, tiles, usable

#: Levels of a quantised impact, to either side of 0, and the levels at which one group of segments ends and the next begins.
LEVELS, BANDS = 64, (32, 16, 8, 4, 2, 0)
#: Rows, queries and components of a block, about, and queries whose scores are held at once.
BLOCKS, TOGETHER = (1 << 16, 256, 1 << 22), 32


class Index:
    """The impact-ordered postings of one block of rows.

    A posting says that a row has some quantised impact in a dimension: the component in LEVELS steps of the dimension's
    largest one. Postings of equal impact are a segment, over all dimensions; segments lie by descending impact, in groups.
    As every row has a posting in every dimension, a group is an array of rows and dimensions, 0 where there is none.
    ``rest`` has for each group the norms of what the rows hold beyond the impacts up to it.
    """

    def __init__(self, c: np.ndarray):
        x = c / power_above(c)
        step = np.abs(x).max(0, initial=0.0) / LEVELS
        level = np.rint(x / np.where(step > 0, step, 1.0)).astype(np.int16)
        size = np.abs(level)
        self.groups, self.rest, above = [], [], LEVELS + 1
        for lowest in BANDS:
            self.groups.append(np.where((size > lowest) & (size < above), level * step, 0.0).astype(np.float32).T.copy())
            left = np.where(size > lowest, x - level * step, x)
            self.rest.append(np.sqrt((left * left).sum(1)) * (1 + 1e-9) + 1e-12)
            above = lowest + 1
        self.norms = np.sqrt((x * x).sum(1))


def _exact_scores(rows: np.ndarray, query: np.ndarray, scale: float) -> np.ndarray:
    """Inner products of the whole numbers rows * scale and query * scale: of any size, beyond what doubles hold exactly."""
    if not len(rows) or float(np.abs(rows).max()) * scale < 2.0**53 / (float(np.abs(query).max()) * scale * len(query) + 1):
        return ((rows * scale) @ (query * scale)).astype(np.int64)
    whole = lambda row: [int(x) * int(scale) if abs(x) >= 2.0**53 else int(x * scale) for x in row]
    own = whole(query.tolist())
    return np.array([sum(a * b for a, b in zip(whole(row), own, strict=True)) for row in rows.tolist()], object)


def impact_ordered(k: int, scale: float):
    """A search of one tile, score at a time, of some queries together.

    Groups of segments are processed by descending impact; each adds query component times impact to the scores of its
    rows. What is still to come for a row, and what quantisation left out, is at most the query's norm times the row's
    rest (Cauchy-Schwarz). The search stops as soon as this proves all but a few rows to be below the k-th best; these
    possible members are scored exactly, in whole numbers. Scores are summed in single precision, which the bounds allow for.
    """

    def search(q, c_ids, c, own):
        index, few = Index(c), max(4 * k, len(c) // 64)
        top = power_above(q)
        for at in range(0, len(q), TOGETHER):
            query = q[at : at + TOGETHER] / top
            size = np.sqrt((query * query).sum(1))[:, None]
            have = np.zeros((len(query), len(c)), np.float32)
            me = c_ids[None, :] == own[at : at + TOGETHER, None]
            have[me] = -np.inf
            # a sum of as many products as there are components, each rounded to 24 bits
            rounding = size * index.norms * (2 * c.shape[1] + 8) * 2.0**-24 + 1e-30
            for group, rest in zip(index.groups, index.rest, strict=True):
                have += query.astype(np.float32) @ group
                last = rest is index.rest[-1]
                if len(c) <= k or (not last and np.median(rest) > 0.2 * np.median(index.norms)):
                    continue
                slack = size * rest + rounding
                least = np.partition(have - slack, len(c) - k, axis=1)[:, len(c) - k]
                possible = have + slack >= least[:, None]
                if last or possible.sum(1).max() <= few:
                    break
            else:
                possible = np.ones(have.shape, bool)
            for row, original in zip(possible & ~me, q[at : at + TOGETHER], strict=True):
                alive = np.flatnonzero(row)
                yield alive, _exact_scores(c[alive], original, scale)

    return search


def exact_top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """Each query's k highest inner products of the integer vectors floor(scale * component), scale a power of two.

    Queries are the rows of ``vectors`` (``vec_id, embedding``) whose vec_id is divisible by ``every``; candidates are all
    rows but those with the query's vec_id. Returns ``query_id, rank, vec_id, score``; ties go to the smaller vec_id, a
    query with fewer candidates gets all. Vectors that are null or empty or hold null or non-finite components take no
    part, nor do rows without vec_id; vectors meet those of their own length only. Components of any size are scored
    exactly: a score beyond 64 bits is ranked by its exact value and returned as the nearest number of 64 bits. Equal
    rows count once; rows of one vec_id with different vectors are candidates each, and as queries they get the best
    of all their results together. Extra columns are ignored; an empty table gives no rows.
    """
    if np.frexp(scale)[0] != 0.5:
        raise ValueError("scale must be a power of two")
    # whole numbers over scale; from 2 ** 53 on, a double has no fraction, whatever it is multiplied by
    whole = lambda x: F.when(F.abs(x) < 2.0**53 / scale, F.floor(x * scale) / scale).otherwise(x)
    rows = usable(vectors, nonzero=False).withColumn("v", F.transform("v", whole))
    return best(tiles(rows, F.col("id") % every == 0, BLOCKS), impact_ordered(k, scale), k, descending=True, kind="long")


def op6_exact_top_k(spark, sf_dir):
    """The contract's search over all embeddings."""
    return exact_top_k(documents(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
