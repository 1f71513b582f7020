"""Pairwise kernels: global ones in blocks that meet where they are written, local ones in blocks that meet by an equality of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.functions.kernels import kernel_array, kernel_column
from retort.plans.lineage import cut

#: Rows of a block of a global matrix, and bytes of the blocks of a partition.
BLOCK, PART = 1024, 8 << 20


def _packed(rows: DataFrame, block: int) -> DataFrame:
    """``(id, v)`` in blocks ``ids, vs`` of about ``block`` rows, dealt by a hash.

    A partition has blocks of PART bytes, about, or fewer, so that every two partitions are enough tasks.
    """
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    count = max(1, -(-n // block))
    enough = int((4 * rows.sparkSession.sparkContext.defaultParallelism) ** 0.5) + 1
    parts = max(-(-count // max(1, PART // (8 * block * max(1, dim or 1)))), min(count, enough))
    dealt = rows.select("id", "v").withColumn("blk", F.pmod(F.xxhash64("id"), F.lit(count))).repartitionByRange(parts, "blk")
    packed = dealt.groupBy("blk").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("r"))
    return cut(packed.select(F.col("r.id").alias("ids"), F.col("r.v").alias("vs")))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every block of one table next to every block of another: ``a_ids, a_vs, b_ids, b_vs``.

    Tasks read the blocks where they are written, one partition of each side at a time: nothing is shuffled, so that the disk
    in use grows with the rows, not with their square. Tiles of the same block on the left come to few tasks, one after the other.
    """
    counts = [df.rdd.getNumPartitions() for df in (left, right)]
    tasks = 4 * max(counts[0], left.sparkSession.sparkContext.defaultParallelism)
    met = left.toDF("a_ids", "a_vs").hint("shuffle_replicate_nl").crossJoin(right.toDF("b_ids", "b_vs"))
    return met.coalesce(min(tasks, max(1, counts[0] * counts[1])))


def block_pairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every pair of blocks of ``(id, v)``: ``a_ids, a_vs, b_ids, b_vs``.

    A block holds about ``block`` rows, dealt by a hash, so a task's memory does not grow with the table.
    """
    packed = _packed(rows, block)
    return _met(packed, packed)


def block_rectangles(one: DataFrame, two: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every block of one table next to every block of another, as block_pairs() does for one."""
    return _met(_packed(one, block), _packed(two, block))


#: Blocks on the left whose results a task holds.
LEFT = 64


def _by_left(batches, work, join):
    """For each block on the left its ids and ``join`` of ``work`` of its tiles (arrays of a column a row); those of up to LEFT blocks are held."""
    held: dict = {}
    for batch in batches:
        for t in range(len(batch)):
            i, a, j, b = tile(batch, t)
            found = work(i, a, j, b)
            _, before = held.get(i[0], (None, None))
            if before is None and len(held) == LEFT:
                yield from held.values()
                held = {}
            held[i[0]] = i, found if before is None else join(before, found)
    yield from held.values()


def tile(batch, k):
    """Ids and vectors of both sides of a tile."""
    vs = [batch.column(i)[k].values for i in (1, 3)]
    a, b = (np.asarray(v.flatten()).reshape(len(v), -1) for v in vs)
    return np.asarray(batch.column(0)[k].values), a, np.asarray(batch.column(2)[k].values), b


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by |a|^2 + |b|^2 - 2ab; what is within rounding of 0 is 0."""
    norms = (a * a).sum(1)[:, None] + (b * b).sum(1)
    square = norms - 2 * a @ b.T
    return np.sqrt(np.where(square > 1e-12 * norms, square, 0.0))


def global_kernel(rows: DataFrame, kernel: str, sigma: float, **parameters) -> DataFrame:
    """The kernel matrix of ``(id, v)`` in long form: ``i, j, k``."""

    def one(batches):
        for batch in batches:
            for t in range(len(batch)):
                i, a, j, b = tile(batch, t)
                k = kernel_array(kernel, distances(a, b) / sigma, **parameters)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i))), pa.array(k.ravel())], names=["i", "j", "k"])

    return block_pairs(rows).mapInArrow(one, "i long, j long, k double")


def kernel_row_sums(rows: DataFrame, kernels: dict[str, dict], sigma: float) -> DataFrame:
    """Per row and kernel the sum of its row of the matrix: ``id, kernel, total``. A task sums over its tiles before the shuffle."""

    def sums(_i, a, _j, b):
        r = distances(a, b) / sigma
        return np.stack([kernel_array(name, r, **parameters).sum(1) for name, parameters in kernels.items()])

    def one(batches):
        for i, total in _by_left(batches, sums, np.add):
            for name, part in zip(kernels, total, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array([name] * len(i)), pa.array(part)], names=["id", "kernel", "part"])

    parts = block_pairs(rows).mapInArrow(one, "id long, kernel string, part double")
    return parts.groupBy("id", "kernel").agg(F.sum("part").alias("total"))


def nearest_squared(rows: DataFrame) -> DataFrame:
    """Per row the smallest squared distance to another row: ``id, d2``."""

    def least(i, a, j, b):
        d = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0.0)
        d[i[:, None] == j[None, :]] = np.inf
        return d.min(1, initial=np.inf)

    def one(batches):
        for i, d in _by_left(batches, least, np.minimum):
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(d)], names=["id", "d2"])

    return block_pairs(rows).mapInArrow(one, "id long, d2 double").groupBy("id").agg(F.min("d2").alias("d2")).where("d2 < double('inf')")


def length_scale(rows: DataFrame) -> DataFrame:
    """The square root of the median nearest squared distance: ``scale``."""
    from retort.operators.stats import percentiles

    median = percentiles(nearest_squared(rows), "d2", [0.5])[0]
    return rows.sparkSession.createDataFrame([(None if median is None else median**0.5,)], "scale double")


#: Distinct atoms of a block of a local kernel, about.
ATOMS = 2048
#: Weights between elements that may be sent to every task.
WEIGHTS = 100_000


def _atom_blocks(atoms: DataFrame, feature: str, by_element: bool, factors: tuple = ()) -> DataFrame:
    """Distinct atoms with their numbers, packed in blocks: ``kind, blk, mols, zs, fs, ns``; of one element each, if asked.

    A molecule's atoms share a block unless they are more than one holds; then they are dealt by a hash of the atom, so
    that neither a large molecule nor a common element makes a large block. ``factors`` names columns that are summed
    over equal atoms and packed too.
    """
    kind = F.col("z") if by_element else F.lit(0)
    counted = atoms.groupBy("mol", "z", F.col(feature).alias("f")).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in factors)).withColumn("kind", kind)
    sizes = counted.groupBy("kind", F.col("mol").alias("_m")).agg(F.count("*").alias("_size"))
    totals = sizes.groupBy("kind").agg(F.ceil(F.sum("_size") / ATOMS).alias("_blocks"))
    sizes = sizes.join(totals, "kind").withColumnRenamed("kind", "_k")
    part = F.pmod(F.xxhash64("z", "f"), F.ceil(F.col("_size") / ATOMS))
    placed = counted.join(sizes, (F.col("kind") == F.col("_k")) & (F.col("mol") == F.col("_m")))
    placed = placed.withColumn("blk", F.pmod(F.xxhash64("mol", part), F.col("_blocks")))
    rows = placed.groupBy("kind", "blk").agg(F.collect_list(F.struct("mol", "z", "f", "n", *factors)).alias("r"), F.first("_blocks").alias("blocks"))
    return rows.select("kind", "blk", "blocks", *(F.col(f"r.{c}").alias(f"{c}s") for c in ("mol", "z", "f", "n", *factors)))


_SIDE = ("mols", "zs", "fs", "ns")


def _tiles(one: DataFrame, two: DataFrame, same: bool, factors: tuple = ()) -> DataFrame:
    """Blocks that meet by an equality of element and block number: ``own, other``, both sides, and the second's factors.

    ``same``: of one table, every two blocks once; ``own`` marks a block that meets itself, ``other`` two different ones.
    """
    more = [f"{c}s" for c in factors]
    side = lambda x, names: [F.col(c).alias(f"{x}_{c}") for c in names]
    blocks = two.groupBy("kind").agg(F.first("blocks").alias("_to"))
    left = one.join(blocks, "kind").withColumn("meet", F.explode(F.sequence(F.col("blk") if same else F.lit(0).cast("long"), F.col("_to") - 1)))
    left = left.select("kind", "meet", F.col("blk").alias("a_blk"), *side("a", _SIDE))
    tiles = left.join(two.select("kind", F.col("blk").alias("meet"), *side("b", (*_SIDE, *more))), ["kind", "meet"])
    own, other = F.lit(same) & (F.col("a_blk") == F.col("meet")), F.lit(same) & (F.col("a_blk") != F.col("meet"))
    return tiles.select(own.alias("own"), other.alias("other"), *(f"{x}_{c}" for x in "ab" for c in _SIDE), *(f"b_{c}" for c in more))


def atom_tiles(one: DataFrame, two: DataFrame, mode: str, same: bool) -> DataFrame:
    """The tiles of two atom tables, or of one with itself."""
    feature, _ = _kinds(two)
    blocks = cut(_atom_blocks(one, feature, mode == "elemental"))
    return _tiles(blocks, blocks if same else cut(_atom_blocks(two, feature, mode == "elemental")), same)


def read_side(batch, t: int, at: int):
    """Molecules, elements, features and numbers of atoms of one side of a tile, from column ``at`` on."""
    mols, zs, fs, ns = (batch.column(at + k)[t].values for k in range(4))
    f = np.asarray(fs.flatten() if pa.types.is_list(fs.type) else fs, float).reshape(len(mols), -1)
    return mols.to_pylist(), np.array(zs.to_pylist(), object), f, np.asarray(ns, float)


def weighed(k: np.ndarray, z: np.ndarray, y: np.ndarray, weigh: dict | None) -> np.ndarray:
    """A tile of a kernel times the weights of the elements of its rows and columns; a missing weight is an error."""
    if weigh is None or not k.size:
        return k
    (us, ui), (vs, vi) = np.unique(z, return_inverse=True), np.unique(y, return_inverse=True)
    missing = [(a, b) for a in us for b in vs if (min(a, b), max(a, b)) not in weigh]
    if missing:
        raise ValueError(f"no weight for {missing[0]}")
    return k * np.array([[weigh[min(a, b), max(a, b)] for b in vs] for a in us])[ui][:, vi]


def _by_molecules(m: list, l: list, k: np.ndarray, own: bool, other: bool):
    """The sums of a tile of atoms over pairs of molecules: names and sums; i <= j only, if the tile is of one table."""
    (i, ii), (j, jj) = np.unique(np.array(m, object), return_inverse=True), np.unique(np.array(l, object), return_inverse=True)
    sums = np.zeros((len(i), k.shape[1]))
    np.add.at(sums, ii, k)
    total = np.zeros((len(j), len(i)))
    np.add.at(total, jj, sums.T)
    p, q = np.meshgrid(i, j, indexing="ij")
    p, q, total = p.ravel(), q.ravel(), total.T.ravel()
    if own:
        keep = np.array(p <= q, bool)
        p, q, total = p[keep], q[keep], total[keep]
    elif other:  # each pair of atoms is in one tile only; within a molecule it counts twice
        total = np.where(p == q, 2 * total, total)
        p, q = np.where(p <= q, p, q), np.where(p <= q, q, p)
    return p, q, total


def _local_sums(tiles: DataFrame, kernel: str, sigma: float, weigh: dict | None, numeric: bool, parameters: dict) -> DataFrame:
    """Sums of the kernel over the atoms of two molecules, tile by tile: ``i, j, k``; summed by molecules before the shuffle."""
    arrow = pa.int64() if numeric else pa.string()

    def scan(batches):
        for batch in batches:
            for t in range(len(batch)):
                own, other = batch.column(0)[t].as_py(), batch.column(1)[t].as_py()
                (m, z, x, n), (l, y, v, w) = read_side(batch, t, 2), read_side(batch, t, 6)
                k = weighed(kernel_array(kernel, distances(x, v) / sigma, **parameters) * n[:, None] * w, z, y, weigh)
                p, q, total = _by_molecules(m, l, k, own, other)
                yield pa.RecordBatch.from_arrays([pa.array(p.tolist(), arrow), pa.array(q.tolist(), arrow), pa.array(total)], names=["i", "j", "k"])

    kind = "long" if numeric else "string"
    return tiles.mapInArrow(scan, f"i {kind}, j {kind}, k double").groupBy("i", "j").agg(F.sum("k").alias("k"))


#: Molecules of a block of names.
NAMES = 4096


def _without_atoms(one: DataFrame, two: DataFrame, same: bool) -> DataFrame:
    """A zero for every pair of molecules: ``i, j, k``; of one table i <= j only. Blocks of names meet by their numbers."""
    names = lambda df: df.select("mol").distinct()
    counts = [max(1, -(-names(df).count() // NAMES)) for df in ((one,) if same else (one, two))]
    packed = lambda df, n: names(df).withColumn("blk", F.pmod(F.xxhash64("mol"), F.lit(n))).groupBy("blk").agg(F.collect_list("mol").alias("mols"))
    left = packed(one, counts[0])
    right = (left if same else packed(two, counts[-1])).toDF("meet", "others")
    left = left.withColumn("meet", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(counts[-1] - 1).cast("long"))))
    out = left.join(right, "meet").select(F.explode("mols").alias("i"), "others").select("i", F.explode("others").alias("j"), F.lit(0.0).alias("k"))
    return out.where("i <= j") if same else out


def local_products(rows: DataFrame, train: DataFrame, coefficients: DataFrame, names: list[str], kernel: str, sigma: float, mode: str = "all", weights: DataFrame | None = None, **parameters) -> DataFrame:
    """Sums of the normalised local kernel times coefficients over the molecules of ``train``: ``mol``, and one column each.

    coefficients: ``mol`` and a column for each of ``names``; molecules without count for nothing. A tile of atoms gives one
    number for each of its molecules in ``rows``, so no pair of molecules is made. A molecule that meets none gets 0.
    """
    feature, numeric = _kinds(train)
    own = lambda df: self_kernel(df, kernel, sigma, mode, weights, **parameters).select(F.col("i").alias("mol"), F.sqrt("k").alias("_s"))
    scaled = coefficients.join(own(train), "mol").select("mol", *((F.col(c) / F.col("_s")).alias(c) for c in names))
    two = cut(_atom_blocks(train.join(scaled, "mol"), feature, mode == "elemental", tuple(names)))
    tiles = _tiles(_atom_blocks(rows, feature, mode == "elemental"), two, False, tuple(names))
    weigh, arrow = known_weights(weights if mode == "alchemical" else None), pa.int64() if numeric else pa.string()

    def scan(batches):
        for batch in batches:
            for t in range(len(batch)):
                (m, z, x, n), (_, y, v, _) = read_side(batch, t, 2), read_side(batch, t, 6)
                factors = np.stack([np.asarray(batch.column(10 + k)[t].values, float) for k in range(len(names))], 1)
                k = weighed(kernel_array(kernel, distances(x, v) / sigma, **parameters), z, y, weigh)
                i, ii = np.unique(np.array(m, object), return_inverse=True)
                sums = np.zeros((len(i), len(names)))
                np.add.at(sums, ii, n[:, None] * (k @ factors))
                yield pa.RecordBatch.from_arrays([pa.array(i.tolist(), arrow), *(pa.array(c) for c in sums.T)], names=["mol", *names])

    kind = "long" if numeric else "string"
    sums = tiles.mapInArrow(scan, f"mol {kind}, " + ", ".join(f"{c} double" for c in names)).groupBy("mol").agg(*(F.sum(c).alias(c) for c in names))
    return own(rows).join(sums, "mol", "left").select("mol", *((F.coalesce(c, F.lit(0.0)) / F.col("_s")).alias(c) for c in names))


#: A moment's grid of distances, the largest scaled one, and the degree of the polynomial. Fixed values of the published program.
GRID, LARGEST, DEGREE = [1.5 ** (-15 + 30 * k / 19) for k in range(20)], 20.0, 20
#: The kernels that a polynomial in a power of the distance stands for, and that power.
POWERS = {"Exponential": 1, "Gaussian": 2}


def local_moments(atoms: DataFrame, power: int, mode: str = "all") -> DataFrame:
    """Sums of x ** p over the atoms of two molecules, x a power of their distance, up to each bin of GRID: ``i, j, bin, m0 ...``.

    Atoms as of local_kernel(), i <= j. Tiles of atoms are summed by molecules and bins before the shuffle; all length scales
    of a kernel follow from this one pass. Distances beyond the grid drop out, as they do in no scale's sum.
    """
    feature, numeric = _kinds(atoms)
    blocks = cut(_atom_blocks(atoms, feature, mode == "elemental"))
    arrow, edges, width = pa.int64() if numeric else pa.string(), np.array(GRID), DEGREE + 1
    columns = [f"m{p}" for p in range(width)]

    def scan(batches):
        for batch in batches:
            for t in range(len(batch)):
                own, other = batch.column(0)[t].as_py(), batch.column(1)[t].as_py()
                (m, _, x, n), (l, _, v, w) = read_side(batch, t, 2), read_side(batch, t, 6)
                (i, ii), (j, jj) = np.unique(np.array(m, object), return_inverse=True), np.unique(np.array(l, object), return_inverse=True)
                sums = np.zeros((len(i) * len(j) * len(edges), width))
                step = max(1, (1 << 20) // max(1, len(v)))
                for at in range(0, len(x), step):
                    r = distances(x[at : at + step], v) ** power
                    bins = np.searchsorted(edges, r)
                    inside = bins < len(edges)
                    place = ((ii[at : at + step, None] * len(j) + jj) * len(edges) + bins)[inside]
                    r, part = r[inside], (n[at : at + step, None] * w)[inside]
                    for p in range(width):
                        sums[:, p] += np.bincount(place, weights=part, minlength=len(sums))
                        part = part * r
                found = np.flatnonzero(sums[:, 0])
                a, b, bins = i[found // len(edges) // len(j)], j[found // len(edges) % len(j)], found % len(edges)
                sums = sums[found]
                if own:
                    keep = np.array(a <= b, bool)
                    a, b, bins, sums = a[keep], b[keep], bins[keep], sums[keep]
                elif other:
                    sums = np.where((a == b).astype(bool)[:, None], 2 * sums, sums)
                    a, b = np.where(a <= b, a, b), np.where(a <= b, b, a)
                yield pa.RecordBatch.from_arrays([pa.array(a.tolist(), arrow), pa.array(b.tolist(), arrow), pa.array(bins, pa.int32()), *(pa.array(c) for c in sums.T)], names=["i", "j", "bin", *columns])

    kind = "long" if numeric else "string"
    parts = _tiles(blocks, blocks, True).mapInArrow(scan, f"i {kind}, j {kind}, bin int, " + ", ".join(f"{c} double" for c in columns))
    sums = parts.groupBy("i", "j", "bin").agg(*(F.sum(c).alias(c) for c in columns))
    running = Window.partitionBy("i", "j").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("i", "j", "bin", *(F.sum(c).over(running).alias(c) for c in columns))


def local_kernels_of_scales(atoms: DataFrame, kernel: str, sigmas: list[float], mode: str = "all") -> DataFrame:
    """Normalised local kernels for many length scales: ``sigma, i, j, k``, i <= j, from one pass over the atoms.

    ``Exponential`` and ``Gaussian`` only. A scale's sum is a polynomial in the moments up to the last bin below LARGEST
    scales; pairs with nothing there are 0. A scale whose result isn't acceptable() is computed exactly instead.
    """
    power = POWERS[kernel]
    moments = cut(local_moments(atoms, power, mode))
    terms, out = chebyshev_of_exp(LARGEST, DEGREE), None
    names = _without_atoms(atoms, atoms, True)
    for sigma in sigmas:
        q = float(sigma) ** power
        last = min(max(int(np.searchsorted(GRID, LARGEST * q)) - 1, 0), len(GRID) - 1)
        at_last = moments.where(F.col("bin") <= last).groupBy("i", "j").agg(F.max_by(F.struct(*(f"m{p}" for p in range(DEGREE + 1))), "bin").alias("m"))
        value = sum((F.col("m")[f"m{p}"] * (c / q**p) for p, c in enumerate(terms)), F.lit(0.0))
        sums = at_last.select("i", "j", value.alias("k")).unionByName(names).groupBy("i", "j").agg(F.sum("k").alias("k"))
        scaled = cut(normalised(sums))
        if not acceptable(scaled):
            scaled = local_kernel(atoms, kernel, float(sigma), mode)
        scaled = scaled.select(F.lit(float(sigma)).alias("sigma"), "i", "j", "k")
        out = scaled if out is None else out.unionByName(scaled)
    return out


def known_weights(weights: DataFrame | None) -> dict | None:
    """Weights by pair of elements, WEIGHTS at most."""
    if weights is None:
        return None
    rows = weights.select("z1", "z2", F.abs("w").alias("w")).limit(WEIGHTS + 1).collect()
    if len(rows) > WEIGHTS:
        raise ValueError(f"more than {WEIGHTS} weights")
    return {(r["z1"], r["z2"]): float(r["w"]) for r in rows}


def local_kernel(atoms: DataFrame, kernel: str, sigma: float, mode: str = "all", weights: DataFrame | None = None, normalise: bool = True, **parameters) -> DataFrame:
    """Sums of a kernel over pairs of atoms of two molecules: ``i, j, k`` with i <= j, every pair of molecules once.

    atoms: ``mol, z`` and either a number ``x`` or an array ``v``; mol is text or a whole number. Modes: all pairs;
    ``elemental``, where only equal z meet (molecules that share none get 0); ``alchemical``, where each pair is weighted
    by ``weights (z1, z2, w)``, z1 <= z2, and a missing pair is an error. Normalised, k(i, i) = 1. Equal atoms of a
    molecule are counted first, then blocks of atoms meet and are summed by molecules in their task.
    """
    feature, numeric = _kinds(atoms)
    blocks = cut(_atom_blocks(atoms, feature, mode == "elemental"))
    out = _local_sums(_tiles(blocks, blocks, True), kernel, sigma, known_weights(weights if mode == "alchemical" else None), numeric, parameters)
    if mode == "elemental":
        out = out.unionByName(_without_atoms(atoms, atoms, True)).groupBy("i", "j").agg(F.sum("k").alias("k"))
    return normalised(out) if normalise else out


def _kinds(atoms: DataFrame) -> tuple[str, bool]:
    return "x" if "x" in atoms.columns else "v", atoms.schema["mol"].dataType.simpleString() not in ("string", "char", "varchar")


def self_kernel(atoms: DataFrame, kernel: str, sigma: float, mode: str = "all", weights: DataFrame | None = None, **parameters) -> DataFrame:
    """Each molecule with itself: ``i, k``, by equality joins within molecules."""
    feature, _ = _kinds(atoms)
    counted = atoms.groupBy("mol", "z", F.col(feature).alias("f")).agg(F.count("*").alias("n"))
    a, b = (counted.select(F.col("mol").alias("i"), F.col("z").alias(f"z{k}"), F.col("f").alias(f"f{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    met = a.join(b, "i")
    met = met.where("z1 = z2") if mode == "elemental" else met
    d = F.abs(F.col("f1") - F.col("f2")) if feature == "x" else F.sqrt(squared_distance(F.col("f1"), F.col("f2")))
    value = kernel_column(kernel, d / sigma, **parameters) * F.col("n1") * F.col("n2")
    if mode == "alchemical":
        known = weights.select(F.col("z1").alias("_a"), F.col("z2").alias("_b"), F.abs("w").alias("_w"))
        met = met.join(known, (F.least("z1", "z2") == F.col("_a")) & (F.greatest("z1", "z2") == F.col("_b")), "left")
        value = value * F.coalesce("_w", F.raise_error(F.lit("no weight for a pair of elements")).cast("double"))
    return met.groupBy("i").agg(F.sum(value).alias("k"))


def local_kernel_between(rows: DataFrame, train: DataFrame, kernel: str, sigma: float, mode: str = "all", weights: DataFrame | None = None, **parameters) -> DataFrame:
    """The normalised local kernel of every molecule of ``rows`` with every one of ``train``: ``i, j, k``; without a common element 0."""
    feature, numeric = _kinds(train)
    by_element = mode == "elemental"
    one, two = (_atom_blocks(df, feature, by_element) for df in (rows, train))
    out = _local_sums(_tiles(one, two, False), kernel, sigma, known_weights(weights if mode == "alchemical" else None), numeric, parameters)
    if by_element:
        out = out.unionByName(_without_atoms(rows, train, False)).groupBy("i", "j").agg(F.sum("k").alias("k"))
    own = lambda df, x: self_kernel(df, kernel, sigma, mode, weights, **parameters).select(F.col("i").alias(x), F.sqrt("k").alias(f"_{x}"))
    return out.join(own(rows, "i"), "i").join(own(train, "j"), "j").select("i", "j", (F.col("k") / (F.col("_i") * F.col("_j"))).alias("k"))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of double, clamped at 0."""
    return F.greatest(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def normalised(kernel: DataFrame) -> DataFrame:
    """k(i, j) / sqrt(k(i, i) k(j, j)) of a long kernel."""
    own = kernel.where("i = j").select(F.col("i").alias("_m"), F.sqrt("k").alias("_s"))
    one, two = own.toDF("_i", "_si"), own.toDF("_j", "_sj")
    return kernel.join(one, F.col("i") == F.col("_i")).join(two, F.col("j") == F.col("_j")).select("i", "j", (F.col("k") / (F.col("_si") * F.col("_sj"))).alias("k"))


def symmetric(kernel: DataFrame) -> DataFrame:
    """Both triangles of an upper one."""
    return kernel.unionByName(kernel.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "k"))


def kernel_means(rows: DataFrame, kernel: str, sigma: float, **parameters) -> tuple[DataFrame, float]:
    """The mean of each row of the matrix, ``id, mean``, and of all of it."""
    sums = cut(kernel_row_sums(rows, {kernel: parameters}, sigma).select("id", "total"))
    n, total = sums.agg(F.count("*"), F.sum("total")).first()
    return sums.select("id", (F.col("total") / max(n, 1)).alias("mean")), (total or 0.0) / max(n * n, 1)


def centered_sums(rows: DataFrame, kernel: str, sigma: float, **parameters) -> DataFrame:
    """Per row of the centered matrix the sum of squares and the largest value: ``i, power, most``; a row a molecule.

    The centered matrix is the kernel less its row and column means, plus its grand mean. A first pass over the tiles gives
    the means, a second one sums within tiles: the matrix itself is never written or shuffled.
    """
    means, grand = kernel_means(rows, kernel, sigma, **parameters)
    known = rows.join(means, "id").select("id", F.concat("v", F.array("mean")).alias("v"))

    def sums(_i, a, _j, b):
        k = kernel_array(kernel, distances(a[:, :-1], b[:, :-1]) / sigma, **parameters) - a[:, -1:] - b[:, -1] + grand
        return np.stack([(k * k).sum(1), k.max(1)])

    def one(batches):
        for i, (power, most) in _by_left(batches, sums, lambda x, y: np.stack([x[0] + y[0], np.maximum(x[1], y[1])])):
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(power), pa.array(most)], names=["i", "power", "most"])

    return block_pairs(known).mapInArrow(one, "i long, power double, most double").groupBy("i").agg(F.sum("power").alias("power"), F.max("most").alias("most"))


def centered(kernel: DataFrame) -> DataFrame:
    """A full long kernel less its row and column means, plus its grand mean; for kernels that are small enough to be written out.

    The means are aggregates joined back, so that no window gathers a whole matrix in one task.
    """
    rows = kernel.groupBy("i").agg(F.avg("k").alias("_r"))
    columns = kernel.groupBy("j").agg(F.avg("k").alias("_c"))
    grand = kernel.agg(F.avg("k").alias("_g"))
    out = kernel.join(rows, "i").join(columns, "j").join(F.broadcast(grand))
    return out.select("i", "j", (F.col("k") - F.col("_r") - F.col("_c") + F.col("_g")).alias("k"))


def power_moments(pairs: DataFrame, grid: list[float], most: int) -> DataFrame:
    """Sums of x ** p, p = 0 ... most, per pair and up to each bin of a rising grid: ``i, j, bin, p, moment``.

    pairs: ``i, j, x``. A value belongs to the first grid point that is not below it; values above the grid drop out.
    """
    edges = F.array(*(F.lit(float(g)) for g in grid))
    at = F.size(F.filter(edges, lambda g: g < F.col("x")))
    binned = pairs.withColumn("bin", at).where(F.col("bin") < len(grid))
    sums = binned.groupBy("i", "j", "bin").agg(*(F.sum(F.pow("x", F.lit(p))).alias(f"m{p}") for p in range(most + 1)))
    long = sums.select("i", "j", "bin", F.posexplode(F.array(*(f"m{p}" for p in range(most + 1)))).alias("p", "part"))
    running = Window.partitionBy("i", "j", "p").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return long.select("i", "j", "bin", "p", F.sum("part").over(running).alias("moment"))


def chebyshev_of_exp(cutoff: float, degree: int = 20, power: int = 1) -> list[float]:
    """Coefficients c_p of exp(-x ** power) as a polynomial in x on [0, cutoff], from its interpolation at Chebyshev nodes."""
    nodes = np.polynomial.chebyshev.Chebyshev.interpolate(lambda x: np.exp(-(x**power)), degree, [0, cutoff])
    return nodes.convert(kind=np.polynomial.Polynomial).coef.tolist()


def acceptable(kernel: DataFrame) -> bool:
    """Whether an approximated, normalised kernel can be used: no value above 1 + 1e-8, and not all of them above 0.1."""
    most, least = kernel.agg(F.max("k"), F.min("k")).first()
    return most is not None and most <= 1 + 1e-8 and least <= 0.1


def kernel_from_moments(moments: DataFrame, grid: list[float], cutoff: float, scale: float) -> DataFrame:
    """Sums of exp(-x / scale) per pair from power moments: those up to the last bin below cutoff * scale; ``i, j, k``."""
    last = int(np.searchsorted(grid, cutoff * scale, side="right")) - 1
    terms = F.array(*(F.lit(c / scale**p) for p, c in enumerate(chebyshev_of_exp(cutoff))))
    order = Window.partitionBy("i", "j", "p").orderBy(F.desc("bin"))
    latest = moments.where(F.col("bin") <= last).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return latest.groupBy("i", "j").agg(F.sum(F.col("moment") * F.get(terms, F.col("p"))).alias("k"))


def nearest_anchor(values: DataFrame, wanted: list[int]) -> DataFrame:
    """For each wanted training size the value at the anchor nearest in log2: ``n, value``; values: ``anchor, value``."""
    asked = values.select(F.explode(F.array(*(F.lit(n) for n in wanted))).alias("n"), "anchor", "value")
    gap = F.abs(F.log2(F.col("anchor").cast("double")) - F.log2(F.col("n").cast("double")))
    return asked.groupBy("n").agg(F.min_by("value", F.struct(gap, F.col("anchor"))).alias("value"))
