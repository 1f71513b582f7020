"""Kernel ridge regression of any training size: conjugate gradients over tiles of a kernel that is never written out.

A training set is dealt into blocks; every two of them meet in one row, a tile, once. A step multiplies the kernel with some
vectors in the tiles, which compute their part of it anew, and adds the results up in Spark. The driver holds vectors of
one number a row, and some columns of the kernel that make the steps fewer, HELD numbers at most; its work and memory grow with the rows, that of the tiles with their square.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retort.functions.kernels import kernel_array
from retort.operators import pairs
from retort.plans.lineage import cut

#: Rows on a side of a tile and its components, at most, and kernel values that are computed together.
SIDE, COMPONENTS, VALUES = 8192, 1 << 22, 1 << 20
#: Numbers that the driver holds to make the steps fewer (128 MB), and columns of the kernel that they are, at most.
HELD, LANDMARKS = 1 << 24, 512
#: Training rows and components that predictions may send to every task (64 MB); more meet the rows in tiles.
SENT = 8 << 20


def kernel_of(kernel: str, a: np.ndarray, b: np.ndarray, sigma: float, parameters: dict) -> np.ndarray:
    """The kernel of every row of one array with every one of another."""
    of_a, of_b = ((x * x).sum(1) / (sigma * sigma) for x in (a, b))
    if kernel != "Gaussian" or max(of_a.max(initial=0.0), of_b.max(initial=0.0)) > 1e3:
        return kernel_array(kernel, pairs.distances(a, b) / sigma, **parameters)
    # no root of the square is needed, and one product gives the exponents; where they round to more than 0, they are 0
    one, two = np.column_stack([a * (2 / (sigma * sigma)), of_a, np.ones(len(a))]), np.column_stack([b, np.full(len(b), -1.0), -of_b])
    out = one @ two.T
    np.minimum(out, 0.0, out=out)
    return np.exp(out, out=out)


def _summed(parts: DataFrame, sizes: list[int], width: int) -> np.ndarray:
    """The sums by block of rows ``blk, part`` (numbers as bytes), one block after the other."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for blk, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[blk] = total.get(blk, 0) + np.frombuffer(part.as_buffer(), np.float64)
        for blk, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([blk], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["blk", "part"])

    out = {blk: np.frombuffer(bytes(part), np.float64).reshape(-1, width) for blk, part in parts.repartition("blk").mapInArrow(add, "blk int, part binary").collect()}
    return np.concatenate([out.get(k, np.zeros((size, width))) for k, size in enumerate(sizes)])


def _part(blk: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([blk], pa.int32()), pa.array([np.ascontiguousarray(values, np.float64).tobytes()], pa.binary())], names=["blk", "part"])


class GlobalTiles:
    """The kernel of ``(id, v)`` as an operator on vectors; ``ids`` gives the order of their entries."""

    def __init__(self, rows: DataFrame, kernel: str, sigma: float, **parameters):
        self.kernel, self.sigma, self.parameters, self.rows = kernel, sigma, parameters, rows
        spark = rows.sparkSession
        n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
        most = max(1, min(SIDE, COMPONENTS // max(1, dim or 1)))
        side = min(most, max(256, -(-n // int((4 * spark.sparkContext.defaultParallelism) ** 0.5))))
        count = max(1, -(-n // side))
        packed = rows.withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).groupBy("blk").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("r"))
        packed = self.packed = cut(packed.select("blk", F.col("r.id").alias("ids"), F.col("r.v").alias("vs")))
        known = {r["blk"]: r["ids"] for r in packed.select("blk", "ids").toLocalIterator()}
        self.ids = [i for k in range(count) for i in known.get(k, [])]
        self.sizes = [len(known.get(k, [])) for k in range(count)]
        left = packed.select("blk", "vs", F.explode(F.sequence("blk", F.lit(count - 1))).alias("meet"))
        right = packed.select(F.col("blk").alias("meet"), F.col("vs").alias("other"))
        self.tiles = cut(left.join(right, "meet").repartition(min(count * (count + 1) // 2, 4 * spark.sparkContext.defaultParallelism)))

    def multiply(self, vectors: np.ndarray) -> np.ndarray:
        """The kernel times some vectors, as columns."""
        ends, width = np.cumsum([0, *self.sizes]), vectors.shape[1]
        sent = self.rows.sparkSession.sparkContext.broadcast(vectors)
        kernel, sigma, parameters = self.kernel, self.sigma, self.parameters

        def one(batches):
            vectors = sent.value
            for batch in batches:
                for meet, blk, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    a, b = (np.asarray(x.values.flatten()).reshape(len(x.values), -1) for x in (a, b))
                    own, other = vectors[ends[blk] : ends[blk + 1]], vectors[ends[meet] : ends[meet + 1]]
                    mine, theirs, step = [], np.zeros_like(other), max(1, VALUES // max(1, len(b)))
                    for at in range(0, len(a), step):
                        k = kernel_of(kernel, a[at : at + step], b, sigma, parameters)
                        mine.append(k @ other)
                        theirs += k.T @ own[at : at + step]
                    yield _part(blk, np.concatenate(mine))
                    if blk != meet:
                        yield _part(meet, theirs)

        out = _summed(self.tiles.select("meet", "blk", "vs", "other").mapInArrow(one, "blk int, part binary"), self.sizes, width)
        sent.destroy()
        return out


    def columns(self, most: int) -> np.ndarray:
        """Columns of the kernel, ``most`` numbers in all, of rows that are spread over its order, and of these the factor F of F F' near it."""
        n = len(self.ids)
        places = np.unique(np.linspace(0, n - 1, max(1, min(n // 2, most // max(1, n), LANDMARKS))).astype(int)) if n > 1 else np.zeros(0, int)
        if len(places) < 2:
            return np.zeros((n, 0))
        ends, chosen = np.cumsum([0, *self.sizes]), {}
        wanted = [(int(np.searchsorted(ends, k, side="right")) - 1, int(k)) for k in places]
        spark, starts = self.rows.sparkSession, [int(e) for e in ends]
        asked = F.broadcast(spark.createDataFrame([(blk, k - starts[blk]) for blk, k in wanted], "blk int, at int"))
        for r in self.packed.join(asked, "blk").select("blk", "at", F.col("vs")[F.col("at")].alias("v")).collect():
            chosen[starts[r["blk"]] + r["at"]] = r["v"]
        points = np.array([chosen[int(k)] for k in places], float)
        sent = spark.sparkContext.broadcast(points)
        kernel, sigma, parameters = self.kernel, self.sigma, self.parameters

        def one(batches):
            for batch in batches:
                for blk, a in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    a = np.asarray(a.values.flatten()).reshape(len(a.values), -1)
                    step = max(1, VALUES // len(sent.value))
                    for at in range(0, len(a), step):
                        k = kernel_of(kernel, a[at : at + step], sent.value, sigma, parameters)
                        yield pa.RecordBatch.from_arrays([pa.array([blk], pa.int32()), pa.array([at], pa.int32()), pa.array([k.tobytes()], pa.binary())], names=["blk", "at", "part"])

        out = np.zeros((n, len(places)))
        for r in self.packed.select("blk", "vs").mapInArrow(one, "blk int, at int, part binary").toLocalIterator():
            part = np.frombuffer(bytes(r["part"])).reshape(-1, len(places))
            out[starts[r["blk"]] + r["at"] :][: len(part)] = part
        sent.destroy()
        values, vectors = np.linalg.eigh(out[places])
        kept = values > 1e-10 * values[-1]
        turn = vectors[:, kept] / np.sqrt(values[kept])
        for at in range(0, n, 1 << 14):
            out[at : at + (1 << 14), : turn.shape[1]] = out[at : at + (1 << 14)] @ turn
        return out[:, : turn.shape[1]]


class LocalTiles:
    """The normalised local kernel of molecules as an operator on vectors; arguments as of pairs.local_kernel()."""

    def __init__(self, atoms: DataFrame, kernel: str, sigma: float, mode: str = "all", weights: DataFrame | None = None, **parameters):
        self.arguments = (kernel, sigma, mode, weights, parameters)
        own = cut(pairs.self_kernel(atoms, kernel, sigma, mode, weights, **parameters).orderBy("i"))
        self.atoms = atoms
        self.ids, self.norms = [], []
        for row in own.toLocalIterator():
            self.ids.append(row["i"])
            self.norms.append(row["k"] ** 0.5)
        self.sizes, self.norms = [len(self.ids)], np.array(self.norms)
        self.tiles, self.weigh = pairs.atom_tiles(atoms, atoms, mode, True), pairs.known_weights(weights if mode == "alchemical" else None)
        self.tiles = cut(self.tiles)

    def multiply(self, vectors: np.ndarray) -> np.ndarray:
        """The kernel times some vectors, as columns; sums are taken inside the tiles, and no pair of molecules is written."""
        kernel, sigma, _, _, parameters = self.arguments
        scaled = vectors / self.norms[:, None]
        sent = self.atoms.sparkSession.sparkContext.broadcast((dict(zip(self.ids, range(len(self.ids)), strict=True)), scaled))
        weigh, width = self.weigh, vectors.shape[1]

        def one(batches):
            number, vectors = sent.value
            total = np.zeros_like(vectors)
            for batch in batches:
                for t in range(len(batch)):
                    other = batch.column(1)[t].as_py()
                    (m, z, x, n), (l, y, v, w) = pairs.read_side(batch, t, 2), pairs.read_side(batch, t, 6)
                    m, l = (np.array([number[i] for i in names]) for names in (m, l))
                    for at in range(0, len(x), max(1, VALUES // max(1, len(v)))):
                        part = slice(at, at + max(1, VALUES // max(1, len(v))))
                        k = pairs.weighed(kernel_array(kernel, pairs.distances(x[part], v) / sigma, **parameters), z[part], y, weigh)
                        np.add.at(total, m[part], n[part, None] * (k @ (w[:, None] * vectors[l])))
                        if other:
                            np.add.at(total, l, w[:, None] * (k.T @ (n[part, None] * vectors[m[part]])))
            yield _part(0, total)

        out = _summed(self.tiles.mapInArrow(one, "blk int, part binary"), self.sizes, width)
        sent.destroy()
        return out / self.norms[:, None]


def _centred(x: np.ndarray) -> np.ndarray:
    return x - x.mean(0) if len(x) else x


def _near_inverse(tiles, lam: float):
    """A function near the inverse of H K H + lam, from some columns of the kernel; what it returns has mean 0, as its argument has.

    With F F' near K (Nystroem), (F F' + m) ^ -1 r = (r - F (F'F + m) ^ -1 F' r) / m.
    """
    factor = tiles.columns(HELD) if hasattr(tiles, "columns") and lam > 0 else np.zeros((0, 0))
    if not factor.shape[1]:
        return lambda r: r.copy()
    factor -= factor.mean(0)
    inner = factor.T @ factor
    values, vectors = np.linalg.eigh(inner)
    least = lam + max(values[0], 0.0)
    scale = 1 / (np.maximum(values, 0.0) + least)
    return lambda r: _centred((r - factor @ (vectors @ (scale * (vectors.T @ (factor.T @ r))))) / least)


@dataclass
class Model:
    """A fitted regression: coefficients in the order of ``ids``, and what centering needs."""

    tiles: object
    ids: list
    alpha: np.ndarray
    shift: float
    grand: float
    of_columns: float
    steps: int
    left: float
    parameters: dict = field(default_factory=dict)

    def centred(self, product, total):
        """Predictions from the sums of k(x, i) alpha_i and of k(x, i) over the training rows; numbers or Spark columns."""
        whole = float(self.alpha.sum())
        return product - total * (whole / len(self.ids)) - self.of_columns + self.grand * whole + self.shift


def fit(tiles, labels: DataFrame, key: str, lam: float, tolerance: float = 1e-11, most: int = 5000) -> Model:
    """Solves (H K H + lam) alpha = y - mean(y), H subtracting means, by conjugate gradients.

    labels: ``key, y``, one row for each row of the tiles. A step costs one multiplication; their number depends on the
    spectrum, of which columns of the kernel that the driver holds take the largest part away. Stops where the residual is below ``tolerance`` of the labels; not to get there in
    ``most`` steps is an error.
    """
    known = {}
    for row in labels.select(key, F.col("y").cast("double").alias("y")).toLocalIterator():
        known[row[key]] = row["y"]
    y = np.array([known[i] for i in tiles.ids], float)
    shift = float(y.mean()) if len(y) else 0.0
    left = y - shift
    nearer = _near_inverse(tiles, lam)
    x, z, size = np.zeros(len(y)), nearer(left), float(left @ left)
    p, slope = z.copy(), float(left @ z)
    goal, step, means = tolerance**2 * size, 0, np.zeros(0) if not len(y) else None
    while len(y) and (step == 0 or size > goal):
        if step == most:
            raise ArithmeticError(f"{most} steps leave a residual of {size**0.5}")
        columns = np.stack((_centred(p), np.ones(len(y))), 1)[:, : 2 if means is None else 1]
        product = tiles.multiply(columns)
        if means is None:
            means = product[:, 1] / max(1, len(y))
        q = _centred(product[:, 0]) + lam * p
        step += 1
        if not size:
            break
        a = slope / float(p @ q)
        x, left = x + a * p, left - a * q
        z, size = nearer(left), float(left @ left)
        now = float(left @ z)
        p, slope = z + now / slope * p, now
    grand = float(means.mean()) if len(y) else 0.0
    return Model(tiles, tiles.ids, x, shift, grand, float(means @ x), step, size**0.5)


def fit_vectors(train: DataFrame, kernel: str, sigma: float, lam: float, **parameters) -> Model:
    """A regression on ``(id, v, y)``, however many rows; rows without label or vector don't count, ids are unique."""
    rows = cut(train.where("v is not null AND y is not null").select("id", "v", "y"))
    return fit(GlobalTiles(rows.select("id", "v"), kernel, sigma, **parameters), rows, "id", lam)


def predict_vectors(model: Model, rows: DataFrame) -> DataFrame:
    """Predictions for ``(id, v)``: ``id, prediction``. A map over the rows if the training set is small, else tiles."""
    tiles = model.tiles
    spark, kernel, sigma, parameters = rows.sparkSession, tiles.kernel, tiles.sigma, tiles.parameters
    if not model.ids:
        return rows.select("id", F.lit(model.shift).alias("prediction"))
    weights = spark.createDataFrame([(i, float(a)) for i, a in zip(model.ids, model.alpha, strict=True)], f"id {dict(tiles.rows.dtypes)['id']}, alpha double")
    train = tiles.rows.join(weights, "id")
    dim = tiles.rows.select(F.size("v")).first()[0]

    def sums(x, v, alpha):
        k = kernel_array(kernel, pairs.distances(x, v) / sigma, **parameters)
        return k @ alpha, k.sum(1)

    if len(model.ids) * dim <= SENT:
        known = train.collect()
        sent = spark.sparkContext.broadcast((np.array([r["v"] for r in known], float), np.array([r["alpha"] for r in known])))

        def one(batches):
            v, alpha = sent.value
            for batch in batches:
                x = np.asarray(batch.column(1).flatten(), float).reshape(len(batch), -1)
                step = max(1, VALUES // len(v))
                parts = [sums(x[at : at + step], v, alpha) for at in range(0, len(x), step)]
                product, total = (np.concatenate(p) if parts else np.empty(0) for p in (zip(*parts, strict=True) if parts else ((), ())))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model_of(product, total))], names=["id", "prediction"])

        whole, count, columns, grand, shift = float(model.alpha.sum()), len(model.ids), model.of_columns, model.grand, model.shift
        model_of = lambda product, total: product - total * (whole / count) - columns + grand * whole + shift
        return rows.select("id", F.col("v").cast("array<double>")).mapInArrow(one, f"id {dict(rows.dtypes)['id']}, prediction double")

    def tile(batches):
        for batch in batches:
            for t in range(len(batch)):
                i, x, _, v = pairs.tile(batch, t)
                product, total = sums(x, v[:, :-1], v[:, -1])
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(product), pa.array(total)], names=["id", "product", "total"])

    met = pairs.block_rectangles(rows.select("id", "v"), train.select("id", F.concat("v", F.array("alpha")).alias("v")))
    parts = met.mapInArrow(tile, "id long, product double, total double").groupBy("id").agg(F.sum("product").alias("p"), F.sum("total").alias("t"))
    return parts.select("id", model.centred(F.col("p"), F.col("t")).alias("prediction"))


def fit_molecules(atoms: DataFrame, labels: DataFrame, kernel: str, sigma: float, lam: float, mode: str = "all", weights: DataFrame | None = None, **parameters) -> Model:
    """A regression on normalised local kernels of ``atoms`` (mol, z, and x or v) to ``labels`` (mol, y)."""
    return fit(LocalTiles(atoms, kernel, sigma, mode, weights, **parameters), labels, "mol", lam)


def predict_molecules(model: Model, atoms: DataFrame) -> DataFrame:
    """Predictions for molecules given by their atoms: ``mol, prediction``; sums are taken inside tiles of atoms."""
    kernel, sigma, mode, weights, parameters = model.tiles.arguments
    kind = dict(model.tiles.atoms.dtypes)["mol"]
    known = [(i, float(a), 1.0) for i, a in zip(model.ids, model.alpha, strict=True)]
    coefficients = atoms.sparkSession.createDataFrame(known, f"mol {kind}, alpha double, one double")
    sums = pairs.local_products(atoms, model.tiles.atoms, coefficients, ["alpha", "one"], kernel, sigma, mode, weights, **parameters)
    return sums.select("mol", model.centred(F.col("alpha"), F.col("one")).alias("prediction"))
