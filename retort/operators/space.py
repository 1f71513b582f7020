"""Chemical space: enumeration of stoichiometries, counting with fallbacks, formula tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retort.functions.expressions import Composition
from retort.functions.formulas import asymptotic_count, canonical_label, label_text, let, ln_factorial, path_of_size, pure_label, pure_prefactor, size_of_path, sum_formula
from retort.plans.lineage import cut


def parse_space(text: str) -> list[tuple[str, int]]:
    """Atom types of ``"C:4 P:3,5"`` in order; labels are alphabetic."""
    out = []
    for part in text.split():
        label, _, valences = part.partition(":")
        if not label.isalpha() or not valences:
            raise ValueError(f"cannot read atom type {part!r}")
        out += [(label, int(v)) for v in valences.split(",")]
    return out


def space_text(types: list[tuple[str, int]]) -> str:
    """The text of atom types, valences of a label together."""
    by: dict[str, list[str]] = {}
    for label, valence in types:
        by.setdefault(label, []).append(str(valence))
    return " ".join(f"{label}:{','.join(v)}" for label, v in by.items())


def _split_into(rows: DataFrame, left: str, parts: int, name: str, falling: bool = False) -> DataFrame:
    """All ways to write a number as a sum of ``parts`` numbers, as columns ``name0 ...``; a row each, one part at a time.

    ``falling``: only those in which no part is above the one before, each made once. No array holds the ways.
    """
    for k in range(parts):
        rest = F.col(left) - sum((F.col(f"{name}{j}") for j in range(k)), F.lit(0))
        if k == parts - 1:
            rows = rows.withColumn(f"{name}{k}", rest.cast("int"))
            continue
        low = F.ceil(rest / (parts - k)) if falling else F.lit(0)
        high = F.least(rest, F.col(f"{name}{k - 1}")) if falling and k else rest
        rows = rows.withColumn(f"{name}{k}", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    return rows


def valence_counts(sizes: DataFrame, valences: list[int]) -> DataFrame:
    """Numbers of atoms of each valence, as columns ``_n0 ...`` by falling valence, that a connected molecule of ``natoms`` can have.

    One valence at a time. Prefixes that no rest can complete are dropped before they are spread: atoms left add at most
    the next valence each, and even valences change no parity.
    """
    rows = sizes.where("natoms > 0").withColumns({"_left": F.col("natoms").cast("int"), "_sum": F.lit(0), "_most": F.lit(0)})
    for k, v in enumerate(valences):
        last = k == len(valences) - 1
        rows = rows.withColumn(f"_n{k}", F.col("_left") if last else F.explode(F.sequence(F.lit(0), F.col("_left"))))
        some = F.col(f"_n{k}")
        rows = rows.withColumns({"_left": F.col("_left") - some, "_sum": F.col("_sum") + some * v, "_most": F.when(F.col("_most") > 0, F.col("_most")).when(some > 0, v).otherwise(0)})
        reach = F.col("_sum") + F.col("_left") * (0 if last else valences[k + 1])
        rows = rows.where((reach >= 2 * (F.col("natoms") - 1)) & (reach >= 2 * F.col("_most")))
        if all(w % 2 == 0 for w in valences[k + 1 :]):
            rows = rows.where(F.col("_sum") % 2 == 0)
    return rows.drop("_left", "_sum", "_most")


def _grouped(types: list[tuple[str, int]]) -> tuple[list[int], list[list[str]]]:
    valences = sorted({v for _, v in types}, reverse=True)
    return valences, [elements_of_valence(types, v) for v in valences]


def enumerate_cases(sizes: DataFrame, types: list[tuple[str, int]]) -> DataFrame:
    """Every feasible stoichiometry of each ``natoms`` of a table: its columns and ``stoichiometry``.

    Two stages, so that infeasible degree sequences go before they are spread over elements: numbers of atoms per
    valence, then numbers per element of a valence. Both make rows one level at a time; sequences are dealt to all tasks
    between them. No atoms give no case.
    """
    valences, labels = _grouped(types)
    rows = valence_counts(sizes, valences).repartition(sizes.sparkSession.sparkContext.defaultParallelism)
    columns = []
    for k, own in enumerate(labels):
        rows = _split_into(rows, f"_n{k}", len(own), f"_p{k}_")
        columns += [F.struct(F.lit(label).alias("label"), F.lit(valences[k]).alias("valence"), F.col(f"_p{k}_{j}").alias("count")) for j, label in enumerate(own)]
    return rows.select(*sizes.columns, F.filter(F.array(*columns), lambda t: t["count"] > 0).alias("stoichiometry"))


def enumerate_sequences(sizes: DataFrame, types: list[tuple[str, int]], pure: bool = False) -> DataFrame:
    """Every feasible degree sequence of each ``natoms`` of a table: its columns and ``sequence``, (deg, cnt) by valence and count.

    Atoms of a valence may be of any of its elements, whose names don't matter: their numbers are falling, so that each
    sequence is made once. ``pure``: all atoms of a valence are of one element.
    """
    valences, labels = _grouped(types)
    rows = valence_counts(sizes, valences).repartition(sizes.sparkSession.sparkContext.defaultParallelism)
    columns = []
    for k, own in reversed(list(enumerate(labels))):
        n = 1 if pure else len(own)
        rows = _split_into(rows, f"_n{k}", n, f"_p{k}_", falling=True)
        columns += [F.struct(F.lit(valences[k]).alias("deg"), F.col(f"_p{k}_{j}").alias("cnt")) for j in reversed(range(n))]
    return rows.select(*sizes.columns, F.filter(F.array(*columns), lambda p: p["cnt"] > 0).alias("sequence"))


def elements_of_valence(types: list[tuple[str, int]], valence: int) -> list[str]:
    """Labels of the atom types of a valence, in order."""
    return [label for label, v in types if v == valence]


def max_valence(types: list[tuple[str, int]]) -> int:
    """The largest valence of a space; no types are an error."""
    return max(v for _, v in types)


def degree_sequence(stoichiometry: Column) -> Column:
    """(deg, cnt) of every atom type."""
    return F.transform(stoichiometry, lambda t: F.struct(t["valence"].alias("deg"), t["count"].alias("cnt")))


def label_of(stoichiometry: Column) -> Column:
    """The canonical label as text, the key of count tables."""
    return label_text(canonical_label(degree_sequence(stoichiometry)))


def counts_of(stoichiometry: Column) -> Column:
    """Map of element to count over all valences."""
    labels = F.array_distinct(F.transform(stoichiometry, lambda t: t["label"]))
    return F.map_from_entries(F.transform(labels, lambda s: F.struct(s, F.aggregate(F.filter(stoichiometry, lambda t: t["label"] == s), F.lit(0), lambda a, t: a + t["count"]))))


def select_cases(cases: DataFrame, predicate: str) -> DataFrame:
    """Cases whose composition fits a predicate."""
    counts = counts_of(F.col("stoichiometry"))
    return cases.where(Composition(predicate).column(counts))


def _whole(x: Column) -> Column:
    """A count without its fraction; doubles that are too large for one stay, as 64 bits end before they do."""
    return let(x, lambda v: F.when(v < 2.0**53, F.floor(v).cast("double")).otherwise(v))


def count_cases(cases: DataFrame, known: DataFrame | None = None, paths: DataFrame | None = None, least: int = 20, strict: bool = False) -> DataFrame:
    """Adds ``n``, the number of molecules of each case, and ``source``, where it is from.

    In this order: the exact count of the label (``known``: label, n); the count that its average path length stands for
    (``paths``: label, length); where its pure label has one of these, the path length before the exact count, that count
    with its path scaled by the label's permutations; from ``least`` atoms on the asymptotic count, divided by the
    factorial of the number of atoms of degree 1, and scaled likewise where the label isn't pure. Smaller cases that no
    table knows get null and the source ``missing``. The tables are joined by label after the labels are made distinct.
    """
    spark = cases.sparkSession
    known = known if known is not None else spark.createDataFrame([], "label string, n double")
    paths = paths if paths is not None else spark.createDataFrame([], "label string, length double")
    sequence = canonical_label(degree_sequence(F.col("stoichiometry")))
    keyed = cases.withColumn("_s", sequence).withColumn("label", label_text(F.col("_s")))
    labels = keyed.select("label", F.col("_s").alias("s")).dropDuplicates(["label"]).withColumn("pure", label_text(pure_label(F.col("s"))))
    exact, approx = known.select("label", F.col("n").cast("double").alias("_e")), paths.select("label", F.col("length").alias("_a"))
    out = labels.join(exact, "label", "left").join(approx, "label", "left")
    out = out.join(exact.toDF("pure", "_pe"), "pure", "left").join(approx.toDF("pure", "_pa"), "pure", "left")
    of_path = lambda length: _whole(size_of_path(length))
    known_n = F.coalesce("_e", of_path(F.col("_a")))
    out = out.select("label", "pure", "s", known_n.alias("_n"), F.col("_e").isNotNull().alias("_exact"), F.coalesce(of_path(F.col("_pa")), F.col("_pe")).alias("_base"))
    out = cut(out)
    told = out.where("_n IS NOT NULL").select("label", F.col("_n").alias("n"), F.when(F.col("_exact"), "exact").otherwise("path").alias("source"))

    # only labels that no table has are worked out, each value once
    scaled = lambda n: _whole(size_of_path(path_of_size(n) * pure_prefactor(F.col("s"))))
    sums = F.aggregate("s", F.struct(F.lit(0).alias("atoms"), F.lit(0).alias("ones")), lambda a, p: F.struct((a["atoms"] + p["cnt"]).alias("atoms"), (a["ones"] + F.when(p["deg"] == 1, p["cnt"]).otherwise(0)).alias("ones")))
    rest = out.where("_n IS NULL")
    of_pure = rest.where("_base > 0").select("label", scaled(F.col("_base")).alias("n"), F.lit("pure").alias("source"))
    rest = rest.where("_base IS NULL OR _base <= 0").withColumn("_sums", sums)
    large = rest.where(F.col("_sums.atoms") >= least)
    limit = _whole(_whole(asymptotic_count(F.col("s"))) / F.exp(ln_factorial(F.col("_sums.ones"))))
    limit = let(limit, lambda n: F.when(F.col("label") == F.col("pure"), n).otherwise(scaled(n)))
    of_limit = large.select("label", limit.alias("n"), F.lit("asymptotic").alias("source"))
    none = rest.where(F.col("_sums.atoms") < least).select("label", F.lit(None).cast("double").alias("n"), F.lit("missing").alias("source"))
    if strict and (lost := [r["label"] for r in none.select("label").limit(10).collect()]):
        raise KeyError(f"no count for labels such as {lost}")
    return keyed.drop("_s").join(told.unionByName(of_pure).unionByName(of_limit).unionByName(none), "label")


def draw_cases(counted: DataFrame, draws: int, seed: str = "0") -> DataFrame:
    """Independent draws of stoichiometries, in two stages: ``draw``, and the ``formula, label, stoichiometry`` drawn.

    counted: ``stoichiometry, label, n``. First a sum formula by the number of its molecules, then one of its
    stoichiometries by theirs. Both stages own intervals of running sums that draws fall into, by ranges of the formula and of
    the stoichiometry's text, so no formula is gathered in one task. The draws are hashes of their numbers, which any engine
    with md5 makes again. Cases without molecules are never drawn; if there are no others, an error.
    """
    from retort.operators import sampling

    rows = counted.where("n > 0").select("label", "stoichiometry", F.col("n").cast("double").alias("n"), sum_formula(F.col("stoichiometry")).alias("formula"))
    rows = cut(rows.withColumn("text", F.to_json("stoichiometry")))
    if rows.isEmpty():
        raise ValueError("no molecule to draw")
    formulas = rows.groupBy("formula").agg(F.sum("n").alias("n"))
    first = sampling.drawn(formulas, [], "formula", "n", draws, f"{seed}:formula").select("draw", "formula")
    second = sampling.drawn(rows.select("formula", "text", "n"), ["formula"], "text", "n", draws, f"{seed}:case", first)
    return second.join(rows.drop("n"), ["formula", "text"]).select("draw", "formula", "label", "stoichiometry")


def estimated_only(known: DataFrame, paths: DataFrame, most: float | None = None) -> DataFrame:
    """Labels that have a path length but no exact count, with the count ``n`` it stands for, at most ``most`` if given."""
    rows = paths.select("label", _whole(size_of_path(F.col("length"))).alias("n")).join(known.select("label"), "label", "left_anti")
    return rows if most is None else rows.where(F.col("n") <= most)


def merge_counts(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two tables ``label, n, length`` as one: of path lengths the smaller, and none where an exact count is known."""
    rows = one.select("label", "n", "length").unionByName(two.select("label", "n", "length")).groupBy("label").agg(F.max("n").alias("n"), F.min("length").alias("length"))
    return rows.select("label", "n", F.when(F.col("n").isNull(), F.col("length")).alias("length"))


def missing_labels(cases: DataFrame, known: DataFrame, limit: int = 20) -> DataFrame:
    """Distinct labels, of at most ``limit`` atoms, that the table of counts lacks, pure labels included."""
    s = canonical_label(degree_sequence(F.col("stoichiometry")))
    atoms = F.aggregate("_s", F.lit(0), lambda a, p: a + p["cnt"])
    labels = cases.select(s.alias("_s")).distinct().where(atoms <= limit).select(label_text(F.col("_s")).alias("label"), label_text(pure_label(F.col("_s"))).alias("pure"))
    return labels.join(known.select("label"), "label", "left_anti").join(known.select(F.col("label").alias("pure")), "pure", "left_anti").select("label")


def shared_labels(one: DataFrame, two: DataFrame) -> DataFrame:
    """Labels that both tables have."""
    return one.select("label").intersect(two.select("label"))


def only_in(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows of the first table whose label the second lacks."""
    return one.join(two.select("label").distinct(), "label", "left_anti")


def element_sequence(stoichiometry: Column) -> Column:
    """Every atom's element, by valence, then count, then label."""
    ordered = F.array_sort(F.transform(stoichiometry, lambda t: F.struct(t["valence"].alias("valence"), t["count"].alias("count"), t["label"].alias("label"))))
    return F.flatten(F.transform(ordered, lambda t: F.array_repeat(t["label"], t["count"])))


def largest_valence(stoichiometry: Column) -> Column:
    """The largest valence of an atom that occurs; null without atoms."""
    return F.array_max(F.transform(F.filter(stoichiometry, lambda t: t["count"] > 0), lambda t: t["valence"]))


def types_per_valence(stoichiometry: Column) -> Column:
    """Map of valence to the number of atom types that have it."""
    valences = F.array_sort(F.array_distinct(F.transform(stoichiometry, lambda t: t["valence"])))
    return F.map_from_entries(F.transform(valences, lambda v: F.struct(v, F.size(F.filter(stoichiometry, lambda t: t["valence"] == v)))))


def formula_table(counted: DataFrame) -> DataFrame:
    """Per sum formula the number of molecules, and all its stoichiometries with theirs."""
    rows = counted.withColumn("formula", sum_formula(F.col("stoichiometry")))
    return rows.groupBy("formula").agg(F.sum("n").alias("n"), F.count("*").alias("cases"), F.sort_array(F.collect_list(F.struct("label", "n"))).alias("stoichiometries"))


# The spaces that published count tables cover.
SPACES = {"A": "C:4 O:2 F:1 H:1 Cl:1 Br:1 I:1 P:3,5 N:3,5 S:2,4,6 Si:4", "B": "C:4 O:2 F:1 H:1 Cl:1 Br:1 I:1 P:3,5 N:3"}


def covered_space(spark: SparkSession, types: list[tuple[str, int]] | str) -> DataFrame:
    """A search space as ``label, valence``; types or the name of one of SPACES."""
    return spark.createDataFrame(parse_space(SPACES[types]) if isinstance(types, str) else types, "label string, valence int")
