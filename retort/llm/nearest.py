"""Nearest neighbours by a block matrix join of int8 tiles with quantisation error bounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.llm.common import documents
from retort.llm.vectors import best, power_above, tiles, usable


def _quantised(x: np.ndarray):
    """int8 values (as exact floats), a scale per row, the norm of the quantised row and of what it leaves out."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    values = np.rint(x / scale[:, None])
    back = values * scale[:, None]
    return values.astype(np.int8), scale, np.sqrt((back**2).sum(1)), np.sqrt(((x - back) ** 2).sum(1))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer product of int8 matrices; single precision holds each sum of 1024 terms exactly."""
    out = 0.0
    for k in range(0, a.shape[1], 1024):
        out = out + (a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].T.astype(np.float32)).astype(np.float64)
    return out


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances, in the order of the components; of rows whose squares leave the range of doubles, scaled by a power of two."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        gap = rows - query
        out = np.sqrt(np.cumsum(gap**2, axis=1)[:, -1])
        most = np.abs(gap).max(1)
        for k in np.flatnonzero(~np.isfinite(out) | ((most > 0) & (most < 1e-140))):
            half = rows[k] / 2 - query / 2 if most[k] > 1 else gap[k] / 2
            top = power_above(half)
            out[k] = np.sqrt(np.cumsum((half / top) ** 2)[-1]) * top * 2
    return out


def bounded_tiles(k: int):
    """A search of one tile: int8 products give each squared distance within a bound; survivors are computed in float.

    With x = x' + r, x' quantised, a product errs by at most |q'||r_x| + |x'||r_q| + |r_q||r_x|. A row survives if its
    least distance is within the k-th smallest greatest distance of the tile. Bounds are of vectors over a power of two
    above all components, so that no square overflows; what then underflows is within the slack.
    """

    def search(original, c_ids, rows, own):
        top = max(power_above(original), power_above(rows))
        q, c = original / top, rows / top
        qi, qs, qn, qr = _quantised(q)
        ci, cs, cn, cr = _quantised(c)
        q2, c2 = (q * q).sum(1), (c * c).sum(1)
        for a in range(0, len(q), 128):
            part = slice(a, a + 128)
            dot = _product(qi[part], ci) * qs[part, None] * cs
            slack = qn[part, None] * cr + cn * qr[part, None] + qr[part, None] * cr
            middle = q2[part, None] + c2
            slack = 2 * slack + 1e-12 * middle + 1e-290
            near = middle - 2 * dot
            for row, extra, query, me in zip(near, slack, original[part], own[part], strict=True):
                other = c_ids != me
                most = np.where(other, row + extra, np.inf)
                level = np.partition(most, k - 1)[k - 1] if len(most) >= k else np.inf
                at = np.flatnonzero(other & (row - extra <= level))
                yield at, distances(rows[at], query) if len(at) else np.zeros(0)

    return search


def nearest_neighbours(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Each query's k nearest rows by Euclidean distance in double precision; none is missed.

    Queries are the rows of ``vectors`` (``vec_id, embedding``) whose vec_id is divisible by ``every``; candidates are all
    rows but those with the query's vec_id. Returns ``query_id, rank, vec_id, score``; ties go to the smaller vec_id, a
    query with fewer candidates gets all. Vectors that are null, empty, zero or hold null or non-finite components take
    no part, nor do rows without vec_id; vectors meet those of their own length only. Components may have any finite size.
    Equal rows count once; rows of one vec_id with different vectors are candidates each, and as queries they get the
    best of all their results together. Extra columns are ignored; an empty table gives no rows.
    """
    return best(tiles(usable(vectors, nonzero=True), F.col("id") % every == 0), bounded_tiles(k), k, descending=False, kind="double")


def op10_nearest_neighbours(spark, sf_dir):
    """The contract's search over all embeddings."""
    return nearest_neighbours(documents(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
