"""Molecule tables: geometries in text, element counts, pairwise features."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.functions.expressions import COUNT_COLUMN

# The elements by atomic number.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()


def _symbols() -> Column:
    return F.array(*(F.lit(s) for s in SYMBOLS))


def atoms_of(xyz: Column) -> Column:
    """The atoms of an XYZ text as array of (el, z, x, y, zc): a count, a comment, then symbol or number and coordinates.

    Null texts give null; lines beyond the count are ignored.
    """
    lines = F.split(F.regexp_replace(xyz, "\r", ""), "\n")
    body = F.slice(lines, 3, F.trim(lines[0]).cast("int"))

    def atom(line):
        part = F.split(F.trim(line), r"\s+")
        number = F.when(part[0].rlike("^[0-9]+$"), part[0].try_cast("int"))
        el = F.coalesce(F.get(_symbols(), number - 1), part[0])
        return F.struct(el.alias("el"), F.array_position(_symbols(), el).cast("int").alias("z"), part[1].try_cast("double").alias("x"), part[2].try_cast("double").alias("y"), part[3].try_cast("double").alias("zc"))

    return F.transform(body, atom)


def element_counts(xyz: Column) -> Column:
    """Map of element symbol to count, without reading coordinates."""
    lines = F.split(F.regexp_replace(xyz, "\r", ""), "\n")
    first = F.transform(F.slice(lines, 3, F.trim(lines[0]).cast("int")), lambda line: F.split(F.trim(line), r"\s+")[0])
    names = F.transform(first, lambda s: F.coalesce(F.get(_symbols(), F.when(s.rlike("^[0-9]+$"), s.try_cast("int")) - 1), s))
    return F.map_from_entries(F.transform(F.array_distinct(names), lambda s: F.struct(s, F.size(F.filter(names, lambda t: t == s)))))


def counts_of(xyz: Column, names: list[str]) -> Column:
    """A struct of the named counts, ``n_atoms`` or ``n_<El>``, in one pass over the atoms of an XYZ text."""
    lines = F.split(F.regexp_replace(xyz, "\r", ""), "\n")
    first = F.transform(F.slice(lines, 3, F.trim(lines[0]).cast("int")), lambda line: F.split(F.trim(line), r"\s+")[0])
    start = F.struct(*(F.lit(0).alias(n) for n in names))

    def is_element(token, symbol):
        same = token == symbol
        return same | (token == str(SYMBOLS.index(symbol) + 1)) if symbol in SYMBOLS else same

    one = lambda token, n: F.lit(1) if n == "n_atoms" else is_element(token, n[2:]).cast("int")
    return F.aggregate(first, start, lambda a, token: F.struct(*((a[n] + one(token, n)).alias(n) for n in names)))


def with_counts(molecules: DataFrame, expression: str) -> DataFrame:
    """The molecules with just those count columns that an expression names: ``n_atoms``, ``n_<El>``; absent elements count 0."""
    named = sorted({m[0] for m in COUNT_COLUMN.finditer(expression)} - set(molecules.columns))
    if not named:
        return molecules
    counts = F.when(F.col("xyz").isNotNull(), counts_of(F.col("xyz"), named))
    out = molecules.withColumn("_counts", counts)
    return out.select(*molecules.columns, *(F.col("_counts")[n].alias(n) for n in named))


def select_molecules(molecules: DataFrame, select: str | None = None, label: str | None = None) -> DataFrame:
    """Rows that a selection keeps, with ``label``; calculated columns exist only while they are needed."""
    from retort.functions.expressions import select_column

    own = molecules.columns
    out = with_counts(molecules, f"{select or ''} {label or ''}")
    if select and select.strip():
        out = out.where(select_column(select))
    return out.select(*own, select_column(label).cast("double").alias("label")) if label else out.select(*own)


def checked_selection(molecules: DataFrame, select: str | None = None, label: str | None = None) -> DataFrame:
    """As select_molecules(); a selection that leaves nothing is an error, one that leaves everything gives a warning."""
    out = select_molecules(molecules, select, label)
    before, after = molecules.count(), out.count()
    if after == 0:
        raise ValueError(f"no molecule is left of {before}")
    if select and select.strip() and after == before:
        warnings.warn(f"the selection {select!r} keeps all {before} molecules", stacklevel=2)
    return out


def check_predictions(labelled: DataFrame, more: DataFrame, element: str, needed: list[str]) -> None:
    """Errors if rows to predict lack a needed column or hold an element that the labelled ones don't."""
    if missing := [c for c in needed if c not in more.columns]:
        raise ValueError(f"rows to predict lack {missing}")
    unseen = more.select(F.explode(element).alias("e")).distinct().join(labelled.select(F.explode(element).alias("e")).distinct(), "e", "left_anti")
    if found := [r[0] for r in unseen.limit(5).collect()]:
        raise ValueError(f"rows to predict hold elements without labels: {found}")


def charges(molecules: DataFrame) -> DataFrame:
    """``charge`` (0 if absent) and ``spin_multiplicity`` (1 if absent) as whole numbers."""
    value = lambda c, d: F.coalesce(F.col(c).cast("int"), F.lit(d)) if c in molecules.columns else F.lit(d)
    return molecules.withColumns({"charge": value("charge", 0), "spin_multiplicity": value("spin_multiplicity", 1)})


def element_matrix(atoms: DataFrame, key: str, element: str, elements: list | None = None) -> DataFrame:
    """A row per molecule, a count column per element, by element."""
    return atoms.groupBy(key).pivot(element, elements).count().na.fill(0)


def pair_feature(atoms: DataFrame, key: str, index: str) -> DataFrame:
    """The sum over pairs i < j of (Zi Zj) ** 2.5 exp(-3 d): ``key, feature``; a molecule of one atom has 0.

    atoms: key, index, ``z, x, y, zc``. The join is within a molecule.
    """
    names = ("z", "x", "y", "zc")
    a = atoms.select(key, F.col(index).alias("_i"), *(F.col(c).alias(f"a_{c}") for c in names))
    b = atoms.select(key, F.col(index).alias("_j"), *(F.col(c).alias(f"b_{c}") for c in names))
    pairs = a.join(b, key).where("_i < _j")
    square = lambda c: F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2)
    value = F.pow(F.col("a_z") * F.col("b_z"), 2.5) * F.exp(-3 * F.sqrt(square("x") + square("y") + square("zc")))
    sums = pairs.groupBy(key).agg(F.sum(value).alias("feature"))
    return atoms.select(key).distinct().join(sums, key, "left").na.fill(0.0, ["feature"])


#: Different elements, charges or spins that may become columns.
STATES = 1000


def few_states(rows: DataFrame, column: str) -> list:
    """The different values of a column, in order; more than STATES are an error, as each becomes a column."""
    found = [r[0] for r in rows.select(column).distinct().limit(STATES + 1).collect()]
    if len(found) > STATES:
        raise ValueError(f"more than {STATES} different values of {column}")
    return sorted(found, key=lambda x: (x is not None, x))


def one_hot(rows: DataFrame, column: str, states: list | None = None) -> DataFrame:
    """Adds a 0/1 column for every state of a column, STATES at most; none is left out."""
    found = states or few_states(rows, column)
    return rows.select("*", *((F.col(column) == s).cast("int").alias(f"{column}_{s}") for s in found))


def append_unlabelled(labelled: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables, the second without labels and marked ``is_predict``; columns that one lacks are null."""
    tail = more.drop("label") if "label" in more.columns else more
    return labelled.withColumn("is_predict", F.lit(False)).unionByName(tail.withColumn("is_predict", F.lit(True)), allowMissingColumns=True)


def coulomb_spectrum(atoms: DataFrame, key: str, size: int) -> DataFrame:
    """A global representation: eigenvalues of the Coulomb matrix by size, padded with zeros: ``key, v``."""
    import numpy as np

    def one(pdf):
        import pandas as pd

        z, p = pdf["z"].to_numpy(float), pdf[["x", "y", "zc"]].to_numpy(float)
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
        np.fill_diagonal(d, 1.0)
        m = np.outer(z, z) / d
        np.fill_diagonal(m, 0.5 * z**2.4)
        values = np.linalg.eigvalsh(m)
        values = np.concatenate((values[np.argsort(-np.abs(values))], np.zeros(max(0, size - len(z)))))[:size]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "v": [values.tolist()]})

    return atoms.groupBy(key).applyInPandas(one, f"{key} long, v array<double>")


#: Representations of molecules by name: functions of (atoms, key, **parameters) that give ``key, v``.
REPRESENTATIONS = {"coulomb_spectrum": coulomb_spectrum}


def bag_of_distances(atoms: DataFrame, key: str, index: str, kinds: list[tuple[float, float]], size: int) -> DataFrame:
    """A global representation: per pair of elements (z1 <= z2) the ``size`` smallest distances, ascending, padded with zeros: ``key, v``.

    Pairs of one molecule meet by an equality join; of each kind only the smallest distances are kept.
    """
    names = ("z", "x", "y", "zc")
    a = atoms.select(key, F.col(index).alias("_i"), *(F.col(c).alias(f"a_{c}") for c in names))
    b = atoms.select(key, F.col(index).alias("_j"), *(F.col(c).alias(f"b_{c}") for c in names))
    square = lambda c: F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2)
    pairs = a.join(b, key).where("_i < _j").select(key, F.least("a_z", "b_z").alias("z1"), F.greatest("a_z", "b_z").alias("z2"), F.sqrt(square("x") + square("y") + square("zc")).alias("d"))
    bags = [F.slice(F.array_sort(F.collect_list(F.when((F.col("z1") == p) & (F.col("z2") == q), F.col("d")))), 1, size) for p, q in kinds]
    zeros = F.array_repeat(F.lit(0.0), size)
    rows = pairs.groupBy(key).agg(*(bag.alias(f"_b{k}") for k, bag in enumerate(bags)))
    whole = atoms.select(key).distinct().join(rows, key, "left")
    padded = [F.slice(F.concat(F.coalesce(f"_b{k}", F.array().cast("array<double>")), zeros), 1, size) for k in range(len(kinds))]
    return whole.select(key, F.concat(*padded).alias("v"))


REPRESENTATIONS["bag_of_distances"] = bag_of_distances


def register_representation(name: str, function) -> None:
    """Adds a representation; a taken name is an error."""
    if name in REPRESENTATIONS:
        raise ValueError(f"there is a representation {name!r}")
    REPRESENTATIONS[name] = function


def represent(atoms: DataFrame, name: str, key: str, **parameters) -> DataFrame:
    """The named representation of every molecule: ``key, v``."""
    if name not in REPRESENTATIONS:
        raise ValueError(f"no representation {name!r}; there are {sorted(REPRESENTATIONS)}")
    return REPRESENTATIONS[name](atoms, key, **parameters)


#: Molecules whose sums a task holds before it sends them on.
HELD = 4096


def weighted_sums(atoms: DataFrame, key: str, vector: str = "v", weight: str | None = None) -> DataFrame:
    """Global representations from local ones: per molecule the sum of its atoms' vectors, times a weight: ``key, v``.

    Tasks add up what they have of a molecule before the shuffle, so that one of very many atoms is gathered nowhere. Atoms
    without vector or weight count for nothing; vectors of one molecule that differ in length are an error.
    """
    import numpy as np
    import pyarrow as pa

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = atoms.select(key, F.col(vector).cast("array<double>").alias("v"), w.alias("w")).where(F.col("v").isNotNull() & F.col("w").isNotNull())
    kind = dict(rows.dtypes)[key]

    def add(batches):
        held: dict = {}

        def sent():
            found = pa.RecordBatch.from_arrays([pa.array(list(held), batch.schema.field(0).type), pa.array(list(held.values()), pa.list_(pa.float64())), pa.array([1.0] * len(held))], names=[key, "v", "w"])
            held.clear()
            return found

        for batch in batches:
            for mol, v, w in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                v = np.asarray(v.values, float) * w
                if mol in held:
                    if len(held[mol]) != len(v):
                        raise ValueError(f"vectors of {mol!r} differ in length")
                    held[mol] = held[mol] + v
                else:
                    held[mol] = v
                if len(held) > HELD:
                    yield sent()
        if held:
            yield sent()

    schema = f"`{key}` {kind}, v array<double>, w double"
    return rows.mapInArrow(add, schema).repartition(key).mapInArrow(add, schema).select(key, "v").groupBy(key).agg(F.collect_list("v").alias("v")).select(key, _added("v").alias("v"))


def _added(vectors: str):
    """The sum of a few vectors of one length."""
    return F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), F.get(vectors, F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
