"""Published data sets as molecule tables, from the texts of their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of a QM9 file's second line, "_" for those left out, and energies of free atoms.
QM9_COLUMNS = "A B C mu alpha homo lumo _ r2 zpve _ U H G Cv"
QM9_ATOMS = {"H": -0.500273, "C": -37.846772, "N": -54.583861, "O": -75.064579, "F": -99.718730}
# The basis sets of the GDB-BSIE energies, in the order of their columns.
BSIE_BASES = ("STO-3G", "cc-pVDZ", "cc-pVTZ", "cc-pVQZ", "cc-pV5Z")
BSIE_ELEMENTS = ("H", "C", "N", "O", "F", "S", "Cl")


def _number(text: Column) -> Column:
    """A number, of which exponents may be written ``*^``."""
    return F.replace(text, F.lit("*^"), F.lit("e")).cast("double")


def _lines(content: str = "content") -> Column:
    return F.split(content, "\n", -1)


def qm9_excluded(text: DataFrame) -> DataFrame:
    """Names of molecules to leave out: ``id``, from the list's one text in ``content``; nine lines stand before it and two after."""
    body = F.slice(_lines(), 10, F.greatest(F.size(_lines()) - 11, F.lit(0)))
    return text.select(F.explode(body).alias("line")).select(F.get(F.split(F.trim("line"), r"\s+"), F.lit(0)).alias("id")).where("id <> ''").distinct()


def qm9_molecules(members: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Molecules of the QM9 archive's members (``content``): ``id, xyz, totalenergy, atomisation_energy`` and its other columns.

    The energy is the eleventh number of the second line; free atoms are counted by their letters in the text. ``excluded``
    has the names, ``id``, of those to leave out.
    """
    parts = members.select(_lines().alias("l")).select("l", F.get("l", F.lit(0)).cast("int").alias("n"), F.split(F.trim(F.get("l", F.lit(1))), r"\s+").alias("p"))
    rows = parts.select("p", F.get("p", F.lit(0)).alias("id"), F.concat_ws("\n", F.get("l", F.lit(0)), F.lit(""), F.slice("l", 3, F.col("n"))).alias("xyz"))
    rows = rows.withColumn("xyz", F.replace("xyz", F.lit("*^"), F.lit("e")))
    if excluded is not None:
        rows = rows.join(excluded.select("id").distinct(), "id", "left_anti")
    energy = _number(F.get("p", F.lit(12)))
    atoms = sum((F.regexp_count("xyz", F.lit(e)) * ref for e, ref in QM9_ATOMS.items()), F.lit(0.0))
    others = [_number(F.get("p", F.lit(k + 2))).alias(c) for k, c in enumerate(QM9_COLUMNS.split()) if c != "_"]
    return rows.select("id", "xyz", energy.alias("totalenergy"), (energy - atoms).alias("atomisation_energy"), *others)


def energy_columns(text: DataFrame, prefix: str) -> DataFrame:
    """A table of energies from its one text in ``content``: ``index``, and a column for each basis set; its first line is a head."""
    body = F.slice(_lines(), 2, F.size(_lines()))
    parts = text.select(F.explode(body).alias("line")).where("trim(line) <> ''").select(F.split(F.trim("line"), r"\s+").alias("p"))
    return parts.select(F.get("p", F.lit(0)).cast("long").alias("index"), *(F.get("p", F.lit(k + 1)).cast("double").alias(f"{prefix}/{b}") for k, b in enumerate(BSIE_BASES)))


def bsie_geometries(members: DataFrame) -> DataFrame:
    """Geometries of the GDB-BSIE archive's members (``member, content``): ``index, xyz, geoindex, natoms`` and an atom count per element.

    The index is the file's name, the second line a JSON object with ``geometry_index``. Another element is an error.
    """
    lines = F.split(F.trim("content"), "\n", -1)
    rows = members.select(F.regexp_extract("member", r"([0-9]+)\.xyz$", 1).cast("long").alias("index"), lines.alias("l"))
    atoms = F.slice("l", 3, F.get("l", F.lit(0)).cast("int"))
    rows = rows.select("index", F.get("l", F.lit(0)).cast("int").alias("natoms"), F.get_json_object(F.get("l", F.lit(1)), "$.geometry_index").cast("long").alias("geoindex"), atoms.alias("atoms"))
    rows = rows.withColumn("e", F.transform("atoms", lambda a: F.get(F.split(F.trim(a), r"\s+"), F.lit(0))))
    odd = F.exists("e", lambda x: ~x.isin(*BSIE_ELEMENTS))
    checked = F.when(odd, F.raise_error(F.concat(F.lit("an element that isn't expected in molecule "), F.col("index").cast("string"))).cast("string")).otherwise(F.concat_ws("\n", F.col("natoms").cast("string"), F.lit(""), F.col("atoms")))
    return rows.select("index", checked.alias("xyz"), "geoindex", "natoms", *((F.size("e") - F.size(F.array_remove("e", s))).alias(f"element_{s}") for s in BSIE_ELEMENTS))


def bsie_molecules(rhf: DataFrame, b3lyp: DataFrame, geometries: DataFrame) -> DataFrame:
    """A row for each index of the RHF energies, with geometry and B3LYP energies where there are any."""
    return rhf.join(geometries, "index", "left").join(b3lyp, "index", "left")
