"""Readers and writers of molecule tables, archives, count tables and basis sets, all by Spark's own file access."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the schema of training archives.
ARCHIVE = (
    "hyperopt ARRAY<STRUCT<ntrain BIGINT, sigma DOUBLE, lambda DOUBLE, val_rmse ARRAY<DOUBLE>, val_mae ARRAY<DOUBLE>, train_rmse ARRAY<DOUBLE>, train_mae ARRAY<DOUBLE>>>,"
    "spectrum MAP<STRING, ARRAY<DOUBLE>>, learning_curve ARRAY<STRUCT<ntrain BIGINT, val_rmse DOUBLE, test_rmse DOUBLE, val_mae DOUBLE, test_mae DOUBLE,"
    "hyperparameters STRUCT<sigma DOUBLE, lambda DOUBLE>>>, metadata STRUCT<representation STRING, kernel STRING, detrending ARRAY<STRING>, elemental BOOLEAN,"
    "alchemical STRING, owl STRING, file_hash STRING, file_path STRING, column_name STRING, `limit` BIGINT, `select` STRING, seed BIGINT>"
)


def gzipped(spark: SparkSession, path: str) -> dict[str, bool]:
    """Each file of a path, glob or folder, and whether it is gzip: by its extension, or else by its first two bytes.

    Files are opened by Spark's file systems, wherever they are; no more than two bytes of each are read. Hidden files are
    left out, as Spark's readers do.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[str, bool] = {}
    todo = list(system.globStatus(at) or [])
    while todo:
        found = todo.pop()
        file = found.getPath()
        if found.isDirectory():
            todo += [x for x in system.listStatus(file) if x.getPath().getName()[0] not in "._"]
        elif file.getName().endswith(".gz"):
            out[file.toString()] = True
        else:
            stream = system.open(file)
            out[file.toString()] = [stream.read(), stream.read()] == [0x1F, 0x8B]
            stream.close()
    return out


def is_gzip(spark: SparkSession, path: str) -> bool:
    """Whether any file of a path is gzip."""
    return any(gzipped(spark, path).values())


def _unpacked(batches):
    """Lines of gzip files that come whole, a few thousand at a time."""
    import gzip
    import io
    from itertools import islice

    import pyarrow as pa

    for batch in batches:
        for content in batch.column(0):
            with gzip.open(io.BytesIO(content.as_buffer()), "rt", encoding="utf-8") as lines:
                while part := list(islice(lines, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array([line.rstrip("\n") for line in part if line.strip()], pa.string())], names=["value"])


def read_molecules(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object per line with a mandatory ``xyz``; gzip is known by extension, or else by its magic bytes, file by file.

    Plain and .gz files of any size are read as streams by Spark. Compressed files without the extension, 2 GB each at
    most, are one row each and unpacked line by line; a folder may hold all of these. No files at all are an error.
    """
    found = gzipped(spark, path)
    misnamed = sorted(f for f, packed in found.items() if packed and not f.endswith(".gz"))
    if not misnamed:
        reader = spark.read.schema(schema) if schema else spark.read
        out = reader.json(path)
    else:
        plain = sorted(set(found) - set(misnamed))
        lines = spark.read.format("binaryFile").load(misnamed).select("content").mapInArrow(_unpacked, "value string")
        if plain:
            lines = lines.unionByName(spark.read.text(plain).where("trim(value) <> ''"))
        if schema is None:
            schema = lines.select(F.schema_of_variant_agg(F.parse_json("value"))).first()[0].replace("OBJECT<", "STRUCT<")
        out = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    if "xyz" not in out.columns:
        raise ValueError(f"{path} has no column xyz")
    return out


def read_members(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files in tar archives, plain or compressed, as rows: ``archive, member, content`` (text).

    ``pattern`` is a shell pattern that member names must fit. An archive, 2 GB at most, is read by one task, member by
    member; several archives by several. Folders and links in it are left out.
    """
    import fnmatch
    import io
    import tarfile

    import pyarrow as pa

    def members(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, size = [], 0
                with tarfile.open(fileobj=io.BytesIO(content.as_buffer())) as tar:
                    for member in tar:
                        if not member.isfile() or not fnmatch.fnmatchcase(member.name, pattern):
                            continue
                        rows.append((archive, member.name, tar.extractfile(member).read().decode("utf-8")))
                        size += member.size
                        if size > 1 << 24 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["archive", "member", "content"])
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(members, "archive string, member string, content string")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Training archives, one JSON document per file."""
    return spark.read.schema(ARCHIVE).option("multiLine", True).json(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Alchemical weights ``{"z1,z2": w}`` as ``z1, z2, w`` with |w|; z1 above z2 is an error."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("pair", "w"))
    z = F.split("pair", ",")
    first, second = F.trim(z[0]).cast("int"), F.trim(z[1]).cast("int")
    checked = F.when(first <= second, first).otherwise(F.raise_error(F.concat(F.lit("z1 above z2: "), F.col("pair"))).cast("int"))
    return pairs.select(checked.alias("z1"), second.alias("z2"), F.abs("w").alias("w"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``label value``: a value with a point is a path length, any other an exact count: ``label, n, length``."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(part[0].alias("label"), part[1].alias("_v"))
    real = F.col("_v").contains(".")
    return rows.select("label", F.when(~real, F.col("_v").cast("decimal(38,0)")).alias("n"), F.when(real, F.col("_v").cast("double")).alias("length"))


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of formulas and frequencies with a header: ``SF, freq``."""
    return spark.read.csv(path, header=True, inferSchema=True).toDF("SF", "freq").select("SF", F.col("freq").cast("long").alias("freq"))


def read_basis(spark: SparkSession, path: str) -> DataFrame:
    """A Gaussian basis file: ``element, shell, l, exp, coef``, shells numbered from 0 within an element."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?im)^\s*(?:spherical|cartesian)\s*$", "").alias("value"))
    blocks = text.select(F.explode(F.split("value", r"(?m)^\*{4}\s*$")).alias("b")).where(F.col("b").rlike(r"[A-Za-z]"))
    blocks = blocks.select(F.initcap(F.regexp_extract("b", r"(?m)^\s*-?([A-Za-z]{1,2})\s+0\s*$", 1)).alias("element"), "b").where("element <> ''")
    shells = blocks.select("element", F.posexplode(F.regexp_extract_all("b", F.lit(r"(?m)^\s*([SPDFGHI])\s+\d+\s+[\d.]+\s*\n((?:\s*[-+\d.]+(?:[DdEe][-+]?\d+)?\s+[-+\d.]+(?:[DdEe][-+]?\d+)?[ \t]*\n?)+)"), F.lit(0))).alias("shell", "s"))
    lines = F.filter(F.split("s", "\n"), lambda x: F.trim(x) != "")
    l = F.expr("instr('SPDFGHI', upper(regexp_extract(s, '([A-Za-z])', 1))) - 1")
    shells = shells.select("element", "shell", l.alias("l"), F.explode(F.slice(lines, 2, F.size(lines))).alias("line"))
    number = lambda k: F.regexp_replace(F.split(F.trim("line"), r"\s+")[k], "[Dd]", "E").cast("double")
    return shells.select("element", "shell", "l", number(0).alias("exp"), number(1).alias("coef"))


def read_generated(spark: SparkSession, path: str) -> DataFrame:
    """What an external graph generator said, a file per run: ``path, n``, the count in the line that holds ``>Z generated``."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("t"), "value").where(F.col("value").contains(">Z generated"))
    return lines.select("path", F.element_at("t", -4).cast("long").alias("n"))


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Graphs that an external generator listed, a line each: ``line, elements, bonds``; the line's text tells graphs apart.

    A line's third word is the elements with their numbers, pseudo elements of two letters from A, and its other words are bonds
    like ``0-1``, ``0=2`` or ``1#2``: array of (u, v, bond).
    """
    words = spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias("line"), F.split(F.trim("value"), r"\s+").alias("w"))
    names, counts = (F.regexp_extract_all(F.get("w", 2), F.lit("(A[a-z])([0-9]*)"), F.lit(k)) for k in (1, 2))
    elements = F.flatten(F.zip_with(names, counts, lambda e, n: F.array_repeat(e, F.when(n == "", 1).otherwise(n.try_cast("int")))))
    part = lambda b, k: F.regexp_extract(b, "^([0-9]+)([^0-9])([0-9]+)$", k)
    bond = lambda b: F.struct(part(b, 1).cast("int").alias("u"), part(b, 3).cast("int").alias("v"), F.instr(F.lit("-=#"), part(b, 2)).alias("bond"))
    return words.select("line", elements.alias("elements"), F.transform(F.slice("w", 4, F.greatest(F.size("w") - 3, F.lit(0))), bond).alias("bonds"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of files: ``path, sha256``."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def write_counts(table: DataFrame, path: str) -> None:
    """Lines ``label value`` that read_counts() reads: exact counts ``n`` as whole numbers, path lengths ``length`` with a point."""
    value = F.coalesce(F.col("n").cast("decimal(38,0)").cast("string"), F.col("length").cast("string"))
    table.select(F.concat_ws(" ", "label", value).alias("value")).write.text(path)


def write_csv(table: DataFrame, path: str) -> None:
    """A table with a header."""
    table.write.csv(path, header=True)


def with_predictions(records: DataFrame, predictions: DataFrame, key: str, column: str) -> DataFrame:
    """The records with the predictions ``key, prediction`` as a column; unequal numbers are an error, an own column is replaced with a warning."""
    n, m = records.count(), predictions.count()
    if n != m:
        raise ValueError(f"{m} predictions for {n} records")
    if column in records.columns:
        warnings.warn(f"column {column!r} is replaced", stacklevel=2)
    value = F.when(~F.isnan("prediction"), F.col("prediction"))
    return records.drop(column).join(predictions.select(key, value.alias(column)), key, "left")


def write_predictions(rows: DataFrame, path: str, compress: bool = False) -> None:
    """JSON lines, nulls written out, into a new folder; Spark cannot replace what it is reading."""
    writer = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write
    (writer.option("compression", "gzip") if compress else writer).text(path)


def write_residuals(rows: DataFrame, path: str) -> None:
    """Residuals ``xyz, ntrain, residual`` as one gzipped JSON line per molecule with a column N<ntrain> each."""
    sizes = [r[0] for r in rows.select("ntrain").distinct().orderBy("ntrain").collect()]
    wide = rows.groupBy("xyz").pivot("ntrain", sizes).agg(F.first("residual"))
    write_predictions(wide.toDF("xyz", *(f"N{n}" for n in sizes)), path, compress=True)


def write_archive(archives: DataFrame, path: str) -> None:
    """Archives as JSON lines, in the schema that read_archive() reads."""
    archives.write.json(path)


def write_basis(basis: DataFrame, path: str) -> None:
    """A basis as text, an element's block per row."""
    letter = F.substring(F.lit("SPDFGHI"), F.col("l") + 1, F.lit(1))
    line = F.format_string("%20.10f %20.10f", "exp", "coef")
    shells = basis.groupBy("element", "shell", "l").agg(F.array_join(F.sort_array(F.collect_list(line), asc=False), "\n").alias("lines"), F.count("*").alias("n"))
    shells = shells.withColumn("text", F.concat(letter, F.lit("   "), F.col("n").cast("string"), F.lit("   1.00\n"), "lines"))
    blocks = shells.groupBy("element").agg(F.array_sort(F.collect_list(F.struct("shell", "text"))).alias("s"))
    blocks.select(F.concat(F.col("element"), F.lit("     0\n"), F.array_join(F.transform("s", lambda x: x["text"]), "\n"), F.lit("\n****")).alias("value")).write.text(path)
