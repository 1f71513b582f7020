"""Reproducible samples, splits and weighted choices, by hashes instead of generator state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retort.plans.lineage import cut


def shuffle_key(key: str, seed: str) -> Column:
    """A hash order that any engine with md5 gives."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))


def sample(rows: DataFrame, key: str, size: int, seed: str = "0") -> DataFrame:
    """Exactly ``size`` rows, uniformly and without replacement (all, if fewer): each task keeps its first ones."""
    return rows.orderBy(shuffle_key(key, seed), key).limit(size)


def training_sizes(least: int, most: int) -> list[int]:
    """least, the powers of two between, most."""
    powers = (2**k for k in range(most.bit_length()))
    return sorted({least, most, *(p for p in powers if least < p < most)})


#: Cells whose counts, two numbers each, may be broadcast.
CELLS = 200_000


def numbered(rows: DataFrame, key: str, seed: str, cell: int = 100_000) -> DataFrame:
    """Adds ``position``, from 1, in shuffled order: ranks within cells of the hash range, after the rows of the cells before."""
    n = rows.count()
    cells = max(1, -(-n // cell))
    at = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    placed = rows.withColumn("_h", shuffle_key(key, seed)).withColumn("_c", F.floor(at * cells / F.lit(1 << 32)))
    before = placed.groupBy("_c").count().select("_c", F.coalesce(F.sum("count").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("_c").orderBy("_h", key))
    before = F.broadcast(before) if cells <= CELLS else before
    return placed.withColumn("_r", rank).join(before, "_c").select(*rows.columns, (F.col("_b") + F.col("_r")).alias("position"))


def holdout_split(rows: DataFrame, key: str, maxcount: int, seed: str = "0") -> DataFrame:
    """Adds ``is_train``: the first ``maxcount`` rows in shuffled order; an error unless some rows are left to hold out."""
    if maxcount >= rows.count():
        raise ValueError(f"{maxcount} training rows leave nothing to hold out")
    return numbered(rows, key, seed).select(*rows.columns, (F.col("position") <= maxcount).alias("is_train"))


def fraction(rows: DataFrame, key: str, share: float, seed: str = "0") -> DataFrame:
    """A share of the rows, rounded to whole ones, uniformly and without replacement; by ranks in cells of the hash range."""
    return numbered(rows, key, seed).where(F.col("position") <= round(share * rows.count())).select(*rows.columns)


def cross_validation(rows: DataFrame, key: str, splits: int, share: float = 0.2, cell: int = 100_000) -> DataFrame:
    """Each row in each of ``splits`` random splits: adds ``split`` and ``is_validation``, for exactly ``share`` of the rows, rounded down.

    The rank of a row within a split goes by cells of the hash range, after the rows of the cells before.
    """
    n = rows.count()
    cells = max(1, -(-n // cell))
    out = rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    out = out.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("split").cast("string"))))
    out = out.withColumn("_c", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * cells / F.lit(1 << 32)))
    past = Window.partitionBy("split").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    before = out.groupBy("split", "_c").count().select("split", "_c", F.coalesce(F.sum("count").over(past), F.lit(0)).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("split", "_c").orderBy("_h", key))
    ranked = out.withColumn("_r", rank).join(before, ["split", "_c"])
    return ranked.select(*rows.columns, "split", (F.col("_b") + F.col("_r") <= int(n * share)).alias("is_validation"))


def stratified(rows: DataFrame, key: str, stratum: str, size: int, seed: str = "0", cell: int = 100_000) -> DataFrame:
    """From each stratum its share of ``size``, rounded, at least one row."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    total = rows.count()
    quota = F.greatest(F.lit(1), F.round(F.lit(size) * F.col("_n") / F.lit(max(1, total))).cast("int"))
    quotas = counts.select(F.col(stratum).alias("_s"), quota.alias("_q"), F.ceil(F.col("_n") / cell).alias("_cells"))
    at = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    placed = rows.withColumn("_h", shuffle_key(key, seed)).join(quotas, F.col(stratum).eqNullSafe(F.col("_s")))
    placed = placed.withColumn("_c", F.floor(at * F.col("_cells") / F.lit(1 << 32)))
    # a stratum of most rows is many cells; the rows of those before a row's are counted, not gathered
    past = Window.partitionBy("_s").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_s", "_c").count().select(F.col("_s").alias("_t"), F.col("_c").alias("_d"), F.coalesce(F.sum("count").over(past), F.lit(0)).alias("_b"))
    kept = placed.join(before, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_c") == F.col("_d"))).where("_b < _q")
    rank = F.row_number().over(Window.partitionBy("_s", "_c").orderBy("_h", key))
    return kept.withColumn("_r", rank).where("_b + _r <= _q").select(*rows.columns)


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash that any engine with md5 gives."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def weighted_choice(rows: DataFrame, key: str, weight: str, draws: int, seed: str = "0") -> DataFrame:
    """One row per draw, with probability in proportion to its weight, however large: ``draw, key``.

    An exponential race: the least -ln(u) / weight wins, u a hash of row and draw; a partial minimum per task.
    """
    out = rows.where(F.col(weight) > 0).select(key, weight, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    u = _uniform(F.col(key).cast("string"), F.col("draw").cast("string"), F.lit(seed))
    time = out.select("draw", key, (F.ln(-F.ln(u)) - F.ln(F.col(weight).cast("double"))).alias("_t"))
    return time.groupBy("draw").agg(F.min_by(key, F.struct("_t", key)).alias(key))


def multinomial(rows: DataFrame, key: str, weight: str, draws: int, seed: str = "0", cells: int = 1024) -> DataFrame:
    """How often each key comes in ``draws`` independent draws by weight: ``key, times``; keys that never come are left out.

    Keys own intervals of (0, 1), by running sums in ranges of the key; draws are hashes of their numbers and meet the
    interval they fall into by an equality of cells.
    """
    from retort.operators.stats import ranged, running

    spark = rows.sparkSession
    summed = running(ranged(rows.where(F.col(weight) > 0).select(key, F.col(weight).cast("double").alias("_w")), key), key, {"_high": "_w"})
    whole = summed.agg(F.max("_high").alias("_all"))
    owned = summed.join(F.broadcast(whole)).select(key, ((F.col("_high") - F.col("_w")) / F.col("_all")).alias("_a"), (F.col("_high") / F.col("_all")).alias("_b"))
    at = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1)).cast("int")
    owned = owned.withColumn("_cell", F.explode(F.sequence(at(F.col("_a")), at(F.col("_b")))))
    drawn = spark.range(draws).select(_uniform(F.col("id").cast("string"), F.lit(seed)).alias("_u")).withColumn("_cell", at(F.col("_u")))
    return drawn.join(owned, "_cell").where("_u >= _a AND _u < _b").groupBy(key).agg(F.count("*").alias("times"))


def drawn(rows: DataFrame, by: list[str], key: str, weight: str, draws: int, seed: str, asked: DataFrame | None = None, cells: int = 1024) -> DataFrame:
    """Independent draws by weight within groups: ``draw``, the columns of ``by``, and the ``key`` drawn.

    ``asked`` says which group each draw is of (``draw`` and ``by``); without, all ``draws`` are of all rows. Keys own intervals
    of (0, 1) in their group, by running sums in the order of the key; a draw is a hash of its number and falls into one.
    The sums go by ranges of group and key: sums of ranges, then within a range. Draws and intervals meet by group and
    cell, and the draws of one group by their number too, so that many of them are spread.
    """
    given = [*by, key]
    parts = rows.where(F.col(weight) > 0).select(*given, F.col(weight).cast("double").alias("_w")).repartitionByRange(64, *given)
    parts = cut(parts.withColumn("_range", F.spark_partition_id()))
    inner = Window.partitionBy("_range", *by).orderBy(key)
    past = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_range", *by).agg(F.sum("_w").alias("_s"))
    sums = sums.select("_range", *by, F.coalesce(F.sum("_s").over(past), F.lit(0.0)).alias("_past"))
    width = F.greatest(F.lit(1), F.least(F.lit(cells), F.ceil(F.count("*") / 64))).cast("int")
    whole = parts.groupBy(*by).agg(F.sum("_w").alias("_all"), width.alias("_cells"))
    high = F.col("_past") + F.sum("_w").over(inner)
    owned = parts.join(sums, ["_range", *by]).select(*given, "_w", high.alias("_high"))
    owned = owned.join(whole, by) if by else owned.join(F.broadcast(whole))
    at = lambda x: F.least(F.floor(x * F.col("_cells")), F.col("_cells") - 1).cast("int")
    end = F.when(F.col("_high") >= F.col("_all") * (1 - 1e-12), 1.0).otherwise(F.col("_high") / F.col("_all"))
    owned = owned.select(*given, "_cells", ((F.col("_high") - F.col("_w")) / F.col("_all")).alias("_a"), end.alias("_b"))
    owned = owned.withColumn("_cell", F.explode(F.sequence(at(F.col("_a")), at(F.col("_b")))))
    owned = owned.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(draws // 250_000))))
    asked = asked if asked is not None else rows.sparkSession.range(draws).withColumnRenamed("id", "draw")
    thrown = asked.select("draw", *by, _uniform(F.col("draw").cast("string"), F.lit(seed)).alias("_u"))
    thrown = thrown.join(whole.select(*by, "_cells"), by) if by else thrown.join(F.broadcast(whole.select("_cells")))
    thrown = thrown.withColumn("_cell", at(F.col("_u"))).withColumn("_copy", F.pmod("draw", F.lit(draws // 250_000 + 1)).cast("int"))
    met = thrown.drop("_cells").join(owned.drop("_cells"), [*by, "_cell", "_copy"]).where("_u >= _a AND _u < _b")
    # intervals that touch by rounding may both hold a draw: the first key has it
    return met.groupBy("draw", *by).agg(F.min(key).alias(key))
