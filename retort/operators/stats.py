"""Frequency tables, distribution distances, learning curves and hyper-parameter summaries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.functions.hashing import first_48_bits
from retort.plans.lineage import cut


def merge_frequencies(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Full outer join of ``(key, freq)`` tables: ``key, f1, f2``, gaps 0."""
    return one.select(key, F.col("freq").alias("f1")).join(two.select(key, F.col("freq").alias("f2")), key, "full").na.fill(0, ["f1", "f2"])


def relative_weights(merged: DataFrame) -> DataFrame:
    """Adds ``w1, w2, w``: shares of each frequency and of their sum; 0 where a total is 0.

    Totals are one aggregate joined back, not a window over the table.
    """
    totals = merged.agg(F.sum("f1").alias("_1"), F.sum("f2").alias("_2"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    both = F.col("f1") + F.col("f2")
    return merged.join(F.broadcast(totals)).select(*merged.columns, share(F.col("f1"), F.col("_1")).alias("w1"), share(F.col("f2"), F.col("_2")).alias("w2"), share(both, F.col("_1") + F.col("_2")).alias("w"))


def ranged(rows: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """The rows with ``_p``, the number of a range of the key that they belong to."""
    return cut(rows.repartitionByRange(buckets, key).withColumn("_p", F.spark_partition_id()))


def running(rows: DataFrame, key: str, sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Adds running sums by key within ``by``: name -> summed column. Rows have ``_p`` from ranged().

    Sums within a range, plus those of the ranges before it: no task gets all keys. Of the ranges there are as many
    sums as buckets, times the values of ``by``.
    """
    by = by or []
    past = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_p").agg(*(F.sum(c).alias(f"_s{k}") for k, c in enumerate(sums.values())))
    totals = totals.select(*by, "_p", *(F.coalesce(F.sum(f"_s{k}").over(past), F.lit(0.0)).alias(f"_b{k}") for k in range(len(sums))))
    within = Window.partitionBy(*by, "_p").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(totals, [*by, "_p"])
    return out.select(*rows.columns, *((F.col(f"_b{k}") + F.sum(c).over(within)).alias(name) for k, (name, c) in enumerate(sums.items())))


def cumulative(merged: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """Adds ``c1, c2``: running sums of w1, w2 by key."""
    return running(ranged(merged, key, buckets), key, {"c1": "w1", "c2": "w2"}).drop("_p")


def distances(merged: DataFrame, key: str, eps: float = 1e-10) -> DataFrame:
    """Distances of two distributions, each share raised by ``eps``: one row.

    ``ks``: largest difference of the cumulative shares; ``kl``: sum p ln(p / q) of the shares made to sum to 1 again; areas by
    trapezoids of width 1: ``area_one``, ``area_two`` under the cumulative shares, ``area`` between them, and ``percent``, the
    latter relative to the larger of the others.
    """
    raised = relative_weights(merged).withColumns({"_p1": F.col("w1") + eps, "_p2": F.col("w2") + eps})
    weighted = running(ranged(raised, key), key, {"c1": "_p1", "c2": "_p2"})
    totals = weighted.agg(F.sum("_p1").alias("_a"), F.sum("_p2").alias("_b"))
    gap = F.abs(F.col("c1") - F.col("c2"))
    p, q = F.col("_p1") / F.col("_a"), F.col("_p2") / F.col("_b")
    under = lambda c: F.sum(c) - (F.min_by(c, key) + F.max_by(c, key)) / 2
    out = weighted.join(F.broadcast(totals)).agg(
        F.max(gap).alias("ks"), F.sum(p * F.ln(p / q)).alias("kl"), under(gap).alias("area"), under(F.col("c1")).alias("area_one"), under(F.col("c2")).alias("area_two"))
    return out.withColumn("percent", F.col("area") / F.greatest("area_one", "area_two") * 100)


def two_sample_ks(values: DataFrame) -> DataFrame:
    """The two-sample statistic of ``(side, x)``, side 1 or 2: ``ks``."""
    counts = values.groupBy("x").agg(*(F.sum((F.col("side") == s).cast("long")).alias(f"f{s}") for s in (1, 2)))
    return cumulative(relative_weights(counts), "x").agg(F.max(F.abs(F.col("c1") - F.col("c2"))).alias("ks"))


#: The chances of at most 0, 1, 2, ... under a Poisson distribution of mean 1, as far as doubles tell them from 1.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(18)]


#: Rounds of a bootstrap that are drawn together, and draws that a task holds at once.
ROUNDS, DRAWS = 4096, 1 << 18


def _drawn_ranges(batches, rounds: range, seed: str):
    """Ranges of keys ``_p, _k, f1, f2``, in order, piece by piece: the range, both frequencies as columns, and how often each round draws each key."""
    ends = [f"{r}:{seed}".encode() for r in rounds]
    step = max(1, DRAWS // len(rounds))
    for batch in batches:
        ranges = np.asarray(batch.column(0))
        starts = [b"" if k is None else f"{k}:".encode() for k in batch.column(1).to_pylist()]
        one, two = (np.asarray(batch.column(c), float)[:, None] for c in (2, 3))
        bounds = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
        for low, high in zip(bounds, bounds[1:], strict=False):
            for at in range(low, high, step):
                part = slice(at, min(at + step, high))
                u = (first_48_bits(starts[part], ends) + 0.5) / float(1 << 48)
                yield int(ranges[at]), one[part], two[part], np.searchsorted(POISSON, u, side="right").astype(float)


def _bootstrapped(parts: DataFrame, rounds: range, seed: str, eps: float) -> DataFrame:
    """bootstrap() of some rounds, of rows ``_p, _k, f1, f2``: each task has whole ranges of the key, in order."""
    width = len(rounds)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for p, one, two, times in _drawn_ranges(batches, rounds, seed):
            sums = np.stack([(one * times).sum(0), (two * times).sum(0), times.sum(0)])
            total[p] = total[p] + sums if p in total else sums
        for p, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["p", "sums"])

    sums = {p: np.frombuffer(bytes(x)).reshape(3, width) for p, x in parts.mapInArrow(add, "p int, sums binary").collect()}
    whole = sum(sums.values(), np.zeros((3, width)))
    with np.errstate(divide="ignore"):
        scale = [np.where(x > 0, 1 / x, 0.0) for x in whole[:2]]
    raised = lambda x: [x[k] * scale[k] + eps * x[2] for k in (0, 1)]
    past, before = {}, np.zeros((3, width))
    for p in sorted(sums):
        past[p] = raised(before)
        before = before + sums[p]
    sent = parts.sparkSession.sparkContext.broadcast((past, scale, raised(whole)))

    def scan(batches):
        past, scale, whole = sent.value
        so_far, most, kl = {}, np.zeros(width), np.zeros(width)
        for p, one, two, times in _drawn_ranges(batches, rounds, seed):
            shares = [one * scale[0] + eps, two * scale[1] + eps]
            one, two = (x + np.cumsum(times * s, 0) for x, s in zip(so_far.get(p, past[p]), shares, strict=True))
            so_far[p] = one[-1], two[-1]
            most = np.maximum(most, np.abs(one - two).max(0))
            with np.errstate(divide="ignore", invalid="ignore"):
                a, b = (s / w for s, w in zip(shares, whole, strict=True))
                kl += np.where(times > 0, times * a * np.log(a / b), 0.0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(rounds, pa.int32()), pa.array(most), pa.array(kl)], names=["round", "ks", "kl"])

    drawn = np.flatnonzero(whole[2]) + rounds.start
    found = parts.mapInArrow(scan, "round int, ks double, kl double").groupBy("round").agg(F.max("ks").alias("ks"), F.sum("kl").alias("kl"))
    return found if len(drawn) == width else found.where(F.col("round").isin(drawn.tolist()))


def bootstrap(merged: DataFrame, key: str, rounds: int, seed: str = "0", eps: float = 1e-10) -> DataFrame:
    """Distances of resampled distributions: ``round, ks, kl``, as distances() defines them.

    A round draws the rows with replacement: each one as often as a Poisson number of mean 1 says, the limit of such draws, by
    inversion of a hash of key and round, so that reruns agree; a repeated row counts with its frequencies and
    ``eps`` as often. Keys go to ranges, and a task draws all rounds of its keys, once for the ranges' sums and once more
    for the running sums that go on from them: no draw is written or shuffled, the driver gets three numbers a range and round.
    """
    share = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f)
    sorted_ranges = merged.select(F.col(key).alias("_key"), share("f1"), share("f2")).repartitionByRange(64, "_key").sortWithinPartitions("_key")
    parts = cut(sorted_ranges.select(F.spark_partition_id().alias("_p"), F.col("_key").cast("string").alias("_k"), "f1", "f2"))
    out = None
    for first in range(0, rounds, ROUNDS):
        found = _bootstrapped(parts, range(first, min(first + ROUNDS, rounds)), seed, eps)
        out = found if out is None else out.unionByName(found)
    return out


def sampled_divergences(merged: DataFrame, key: str, shares: list[float], seed: str = "0", eps: float = 1e-10) -> DataFrame:
    """How distances of two columns of frequencies depend on the sample: ``share, n, ks, kl, reverse_kl``, a row per share.

    A share takes that part of the rows, rounded to whole ones, without replacement, in one shuffled order for all of them.
    ``ks`` is the two-sample statistic of the frequencies as values; the others are of the sample's relative frequencies,
    each raised by ``eps`` and then made to sum to 1.
    """
    from retort.operators.sampling import numbered

    n = merged.count()
    rows = cut(numbered(merged.select(key, "f1", "f2"), key, seed))
    out = None
    for share in shares:
        part = rows.where(F.col("position") <= round(share * n))
        values = part.select(F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("f1").cast("double").alias("x")), F.struct(F.lit(2).alias("side"), F.col("f2").cast("double").alias("x")))).alias("v")).select("v.side", "v.x")
        ks = two_sample_ks(values)
        totals = part.agg(F.sum("f1").alias("_1"), F.sum("f2").alias("_2"), F.count("*").alias("n"))
        p, q = (F.coalesce(F.try_divide(F.col(f"f{k}"), F.col(f"_{k}")), F.lit(0.0)) + eps for k in (1, 2))
        raised = part.join(F.broadcast(totals)).select("n", p.alias("p"), q.alias("q"))
        sums = raised.agg(F.max("n").alias("n"), F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("pq"), F.sum(F.col("q") * F.ln(F.col("q") / F.col("p"))).alias("qp"))
        # sum p / P ln((p / P) / (q / Q)) = (sum p ln(p / q)) / P - ln(P / Q)
        both = sums.select(F.coalesce("n", F.lit(0)).alias("n"), (F.col("pq") / F.col("sp") - F.ln(F.col("sp") / F.col("sq"))).alias("kl"), (F.col("qp") / F.col("sq") - F.ln(F.col("sq") / F.col("sp"))).alias("reverse_kl"))
        found = ks.crossJoin(both).select(F.lit(float(share)).alias("share"), "n", "ks", "kl", "reverse_kl")
        out = found if out is None else out.unionByName(found)
    return out


#: Rows of a range of values, about, of which the ones of a rank are looked up.
RANGE = 250_000


def percentiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles of a column, between two ranks in proportion; nulls don't count, and no values give null.

    Values go to ranges by order; the driver gets the ranges' counts, and then the value at each of the few ranks, which a
    window finds inside its range. So no task holds more of the values than a range has.
    """
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    n = values.count()
    if not n:
        return [None] * len(shares)
    parts = cut(values.repartitionByRange(max(1, -(-n // RANGE)), "_v").withColumn("_p", F.spark_partition_id()))
    counts = sorted(map(tuple, parts.groupBy("_p").count().collect()))
    asked = sorted({k for s in shares for k in (int(s * (n - 1)), min(int(s * (n - 1)) + 1, n - 1))})
    places, before = [], 0
    for p, count in counts:
        places += [(p, k - before + 1, k) for k in asked if before <= k < before + count]
        before += count
    wanted = F.broadcast(rows.sparkSession.createDataFrame(places, "_p int, _r int, rank long"))
    ranked = parts.join(wanted.select("_p").distinct(), "_p", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("_v")))
    at = dict(map(tuple, ranked.join(wanted, ["_p", "_r"]).select("rank", "_v").collect()))
    out = []
    for s in shares:
        k = int(s * (n - 1))
        low, high = at[k], at[min(k + 1, n - 1)]
        out.append(low + (high - low) * (s * (n - 1) - k))
    return out


def bootstrap_summary(values: DataFrame, metrics: list[str], alpha: float = 0.05) -> DataFrame:
    """Mean and percentile interval of each metric over the rounds: ``<m>_mean, <m>_low, <m>_high``."""
    out = []
    for m in metrics:
        out += [F.avg(m).alias(f"{m}_mean"), F.percentile(m, F.lit(alpha / 2)).alias(f"{m}_low"), F.percentile(m, F.lit(1 - alpha / 2)).alias(f"{m}_high")]
    return values.agg(*out)


def log_metrics(points: DataFrame, columns: list[str], pairs: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Adds ``log_<column>``, the decimal logarithm, and for each pair the larger of two logarithms; null where there is none."""
    log = lambda c: F.when(F.col(c) > 0, F.log10(c))
    out = points.select("*", *(log(c).alias(f"log_{c}") for c in columns))
    return out.select("*", *(F.greatest(log(a), log(b)).alias(f"log_{name}") for name, (a, b) in (pairs or {}).items()))


def capped(points: DataFrame, column: str, share: float = 0.9) -> DataFrame:
    """The points with values above a percentile set to it."""
    top = percentiles(points, column, [share])[0]
    return points if top is None else points.withColumn(column, F.least(column, F.lit(top)))


def curve_table(points: DataFrame, n: str, metrics: list[str]) -> DataFrame:
    """A learning curve as lines of text, in order of the training size: numbers in scientific form, no number as ``inf``."""
    shown = lambda c: F.when(F.col(c).isNull() | (F.abs(F.col(c)) == float("inf")), "inf").otherwise(F.format_string("%.3e", c))
    return points.select(n, F.concat_ws("  ", F.lpad(F.col(n).cast("string"), 8, " "), *(F.lpad(shown(m), 11, " ") for m in metrics)).alias("line"))


def interval(values: DataFrame, column: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """A percentile interval: ``low, high``."""
    return values.sparkSession.createDataFrame([tuple(percentiles(values, column, [low, high]))], "low double, high double")


def curve_summary(points: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """Median, 33rd and 67th percentile of each metric per training size; size 1 is left out."""
    out = []
    for m in metrics:
        out += [F.median(m).alias(f"{m}_median"), F.percentile(m, F.lit(0.33)).alias(f"{m}_p33"), F.percentile(m, F.lit(0.67)).alias(f"{m}_p67")]
    return points.where(F.col(by) > 1).groupBy(by).agg(*out)


def best_hyperparameters(points: DataFrame, least: int = 5) -> DataFrame:
    """Per training size the (sigma, lambda) of the lowest median error; pairs with fewer than ``least`` splits don't count."""
    medians = points.groupBy("ntrain", "sigma", "lam").agg(F.median("rmse").alias("rmse"), F.count("*").alias("n")).where(F.col("n") >= least)
    return medians.groupBy("ntrain").agg(F.min_by(F.struct("sigma", "lam", "rmse"), F.struct("rmse", "sigma", "lam")).alias("b")).select("ntrain", "b.*")


def curve_slope(points: DataFrame, n: str, error: str, partition: list[str]) -> DataFrame:
    """Adds ``slope``: change of ln error by change of ln n from one training size to the next; null at the first."""
    order = Window.partitionBy(*partition).orderBy(n)
    rise = F.ln(error) - F.lag(F.ln(error)).over(order)
    return points.withColumn("slope", F.try_divide(rise, F.ln(n) - F.lag(F.ln(n)).over(order)))


def converged(errors: DataFrame, by: list[str], index: str, error: str) -> DataFrame:
    """Per group whether medians over even and odd splits differ by less than 5 % of the median of all; needs over 5 splits."""
    even, odd = (F.median(F.when(F.col(index) % 2 == k, F.col(error))) for k in (0, 1))
    return errors.groupBy(*by).agg(F.count("*").alias("n"), even.alias("even"), odd.alias("odd"), F.median(error).alias("all")).withColumn(
        "converged", (F.col("n") > 5) & (F.try_divide(F.abs(F.col("even") - F.col("odd")), "all") < 0.05)
    )


def comparable(archives: DataFrame, fields: list[str]) -> DataFrame:
    """Per metadata field whether all rows agree: ``field, values, agree``; null is a value."""
    counts = archives.agg(*((F.count_distinct(f) + F.max(F.col(f).isNull().cast("int"))).alias(f) for f in fields))
    return counts.select(F.expr(f"stack({len(fields)}, {', '.join(f"'{f}', `{f}`" for f in fields)}) AS (field, values)")).withColumn("agree", F.col("values") <= 1)
