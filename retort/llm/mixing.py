"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retort.llm.common import WORD, cut, documents, small

WEIGHTS = (5, 2, 1)
#: Rows of a source that one cell of its hash-ordered range holds, about.
CELL = 4096
#: Sources or cells, a few numbers each, that may be broadcast.
SMALL = 200_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """A row per source: ``source, rows, source_size, weight, target``.

    Sources by code point, null last, take the weights in turn and share ``share`` times all sizes; no target exceeds
    ``ceiling`` times its source's size, and what is above goes to the others by weight until none is above. This fixed
    point is found by one sort: sources reach their ceiling in the order of ceiling / weight.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    by = _before(by.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"rank": "one"})
    by = by.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    by = by.withColumn("most", F.col("source_size") * F.lit(ceiling)).withColumn("ratio", F.col("most") / F.col("weight"))
    by = cut(_before(by, [F.col("ratio").asc(), F.col("rank").asc()], {"full": "most", "closed": "weight"}))
    # the level that the sources from one on would get; the first that stays below its ceiling fixes it
    whole = by.agg(F.sum("source_size").alias("_size"), F.sum("weight").alias("_weight"))
    level = (F.col("_size") * share - F.col("full")) / (F.col("_weight") - F.col("closed"))
    fixed = by.crossJoin(F.broadcast(whole)).where(level * F.col("weight") <= F.col("most")).agg(F.min_by(level, F.struct("ratio", "rank")).alias("level"))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return by.crossJoin(F.broadcast(fixed)).select("source", "rows", "source_size", "weight", target.alias("target"))


def _before(rows: DataFrame, order: list, sums: dict[str, str], ranges: int = 64) -> DataFrame:
    """Adds to each row the sums over the rows before it in an order: name -> summed column.

    The order is dealt into ranges: sums within a range, plus those of the ranges before it, so no task gets all rows.
    """
    parts = cut(rows.repartitionByRange(ranges, *order).withColumn("_p", F.spark_partition_id()))
    past = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_p").agg(*(F.sum(c).alias(f"_s{k}") for k, c in enumerate(sums.values())))
    totals = totals.select(F.col("_p"), *(F.coalesce(F.sum(f"_s{k}").over(past), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))))
    within = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = parts.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"_w{k}") for k, c in enumerate(sums.values())))
    return inner.join(F.broadcast(totals), "_p").select(*rows.columns, *((F.col(f"_b{k}") + F.col(f"_w{k}")).alias(name) for k, name in enumerate(sums)))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """How many words of each document the mix takes.

    Adds ``size`` (words; null text: 0), ``source_size``, ``target`` and ``taken`` to the columns of ``docs``, which must
    have ``doc_id, text, source``; its own columns of these names are replaced, all others stay, whatever their names.
    ``keep`` names the columns to return, all by default. Each source is ordered by a hash of doc_id (of the text, where
    doc_id is null), taken whole as often as its target allows, and cut in that order where the rest of the budget ends: the taken
    words of a source sum to its target, rounded down. The same rows give the same mix. Rows of equal doc_id, null
    included, are ordered by size and text; equal rows differ in nothing. Empty documents take nothing; an empty table
    gives no rows.

    A source is dealt into cells by ranges of the hash, so one source with most rows is spread like any other:
    sums of cells, prefix sums over the few cells, then prefix sums within a cell.
    """
    own = [c for c in keep or docs.columns if c not in ("size", "source_size", "target", "taken")]
    none = F.concat_ws(":", F.lit("null"), F.md5(F.coalesce("text", F.lit(""))))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), none)))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    row = F.struct(*own) if own else F.lit(None)
    sized = docs.select(row.alias("_row"), F.col("source").alias("_src"), size.alias("size"), key.alias("_key"), F.xxhash64("text").alias("_tie"))
    narrow = sized = cut(sized) if "text" not in own else sized
    if "text" in own:
        narrow = cut(sized.select("_src", "size", "_key"))
    goal = targets(narrow.select(F.col("_src").alias("source"), "size"), weights, share, ceiling)
    goal = small(cut(goal.select(F.col("source").alias("_of"), "source_size", "target", F.ceil(F.col("rows") / CELL).alias("_cells"))), SMALL)

    at = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    placed = lambda df: df.join(goal, df["_src"].eqNullSafe(goal["_of"])).drop("_of").withColumn("_cell", F.floor(at * F.col("_cells") / F.lit(1 << 32)).cast("long"))
    cells = placed(narrow).groupBy("_src", "_cell").agg(F.sum("size").alias("_sum"))
    past = Window.partitionBy("_src").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = small(cut(cells.select(F.col("_src").alias("_of"), F.col("_cell").alias("_at"), F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_before"))), SMALL)

    order = Window.partitionBy("_src", "_cell").orderBy("_key", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed(sized).withColumn("_within", F.coalesce(F.sum("size").over(order), F.lit(0)))
    rows = rows.join(cells, rows["_src"].eqNullSafe(cells["_of"]) & (rows["_cell"] == cells["_at"]))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("_before") - F.col("_within")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select(*(F.col("_row")[c].alias(c) for c in own), "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, ceiling: float = 2.0, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is taken; the one that a budget cuts, if at least half of it is. All columns stay."""
    needed = ("doc_id", "text", "source")
    inner = docs.select(*needed, F.struct(F.lit(0).alias("_none_"), *(c for c in docs.columns if c not in needed)).alias("_doc"))
    out = mix_sources(inner, weights, share, ceiling, seed)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    own = [F.col(c) if c in needed else F.col("_doc")[c].alias(c) for c in docs.columns]
    return out.select(F.struct(*own).alias("_row"), F.explode(F.array_repeat(F.lit(0), times))).select("_row.*")


def op2_mixing(spark, sf_dir):
    """The contract's columns over all documents."""
    return mix_sources(documents(spark, sf_dir), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))) AS k, md5(coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS most FROM r),
o AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
f AS (SELECT min_by(level, (most / weight, rk)) AS level FROM o WHERE level * weight <= most),
t AS (SELECT source, source_size, least(most, coalesce(f.level * weight, most)) AS target FROM o LEFT JOIN f ON true),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, size, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)))::BIGINT AS taken FROM c
"""
