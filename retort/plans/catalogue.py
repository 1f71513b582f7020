"""Registered queries over the driver's tables, each next to the SQL that checks it.

Orders stand for molecules and their lines for atoms, parts and customers for atoms of larger groups, embeddings for
global representations. Every query reads whole tables; results are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retort.functions import formulas
from retort.functions.expressions import Composition, select_column
from retort.functions.kernels import KERNELS
from retort.operators import basis, dimension, graphs, molecules, nuclear, pairs, regression, ridge, sampling, space, stats, taylor
from retort.plans.lineage import cut, scratch
from retort.sources import datasets, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Adds a query, and its SQL if SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _r(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.select(*(_r(c, digits) if c in names else F.col(c) for c in df.columns))


# --- kernels ------------------------------------------------------------------------------------------------------

_PARAMETERS = {"RationalQuadratic": {"alpha": 2.0}, "Power": {"alpha": 1.5}, "GeneralizedCauchy": {"alpha": 1.0, "beta": 1.5}, "Sigmoid": {"a": 2.0, "b": 1.5}, "Polynomial": {"alpha": 1.0, "beta": 1.0}}
_NAMES = {name: _PARAMETERS.get(name, {}) for name in KERNELS if name != "MaternGeneral"}


def _vectors(spark, folder):
    return _t(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


_KERNEL_SQL = """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.id, list_distance(a.v, b.v) / 1.5 AS r FROM e a, e b),
q AS (SELECT id, r, greatest(1 - r, 0) AS t, CASE WHEN r < 1 THEN r ELSE 0 END AS s FROM p),
k AS (SELECT id, unnest([
  {'kernel': 'Gaussian', 'k': exp(-r*r)}, {'kernel': 'Exponential', 'k': exp(-r)},
  {'kernel': 'Matern32', 'k': (1+sqrt(3)*r)*exp(-sqrt(3)*r)}, {'kernel': 'Matern52', 'k': (1+sqrt(5)*r+5*r*r/3)*exp(-sqrt(5)*r)},
  {'kernel': 'RationalQuadratic', 'k': pow(1+r*r/4, -2)}, {'kernel': 'InverseMultiquadric', 'k': 1/sqrt(1+r*r)},
  {'kernel': 'InverseQuadratic', 'k': 1/(1+r*r)}, {'kernel': 'Power', 'k': pow(1+r*r, -1.5)},
  {'kernel': 'GeneralizedCauchy', 'k': pow(1+pow(r, 1.5), -1/1.5)},
  {'kernel': 'WendlandK0', 'k': pow(t,2)}, {'kernel': 'WendlandK1', 'k': pow(t,4)*(4*r+1)}, {'kernel': 'WendlandK2', 'k': pow(t,6)*(35*r*r+18*r+3)/3},
  {'kernel': 'WendlandK3', 'k': pow(t,8)*(32*r*r*r+25*r*r+8*r+1)}, {'kernel': 'WendlandK4', 'k': pow(t,10)*(429*r*r*r*r+450*r*r*r+210*r*r+50*r+5)/5},
  {'kernel': 'WuC2', 'k': pow(t,4)*(4*r+1)}, {'kernel': 'WuC4', 'k': pow(t,6)*(35*r*r+18*r+3)/3}, {'kernel': 'WuC6', 'k': pow(t,8)*(16*r*r*r+25*r*r+10*r+1)},
  {'kernel': 'Bump', 'k': CASE WHEN r < 1 THEN exp(1-1/(1-s*s)) ELSE 0 END}, {'kernel': 'Sigmoid', 'k': (1+exp(-2))/(1+exp(1.5*r-2))},
  {'kernel': 'Polynomial', 'k': (1+r*r)*exp(-r*r)}]) AS x FROM q)
SELECT id, x.kernel AS kernel, round(sum(x.k), 6) AS total FROM k GROUP BY 1, 2
"""


@register("kernel_row_sums", _KERNEL_SQL)
def _kernel_row_sums(spark, folder):
    return _rounded(pairs.kernel_row_sums(_vectors(spark, folder), _NAMES, 1.5), 6, "total")


@register("nn_length_scale", "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT a.id, min(pow(list_distance(a.v, b.v), 2)) AS d FROM e a JOIN e b ON a.id <> b.id GROUP BY 1) SELECT round(sqrt(median(d)), 6) AS scale FROM n")
def _nn_length_scale(spark, folder):
    return _rounded(pairs.length_scale(_vectors(spark, folder)), 6, "scale")


@register("global_kernel_centered", """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
k AS (SELECT a.id AS i, b.id AS j, exp(-pow(list_distance(a.v, b.v) / 1.5, 2)) AS k FROM e a, e b),
c AS (SELECT i, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS k FROM k)
SELECT i, round(sum(k * k), 6) AS power, round(max(k), 6) AS most FROM c GROUP BY i""")
def _centered(spark, folder):
    return _rounded(pairs.centered_sums(_vectors(spark, folder), "Gaussian", 1.5), 6, "power", "most")


def _parts(spark, folder):
    return _t(spark, folder, "part").select(F.col("p_brand").alias("mol"), F.col("p_type").alias("z"), (F.col("p_size") / 10).alias("x"))


_LOCAL = """
WITH a AS (SELECT p_brand AS mol, p_type AS z, p_size / 10 AS x FROM part){weights},
k AS (SELECT a.mol AS i, b.mol AS j, sum({value}) AS k FROM a JOIN a b ON {on} a.mol <= b.mol{join} GROUP BY 1, 2),
d AS (SELECT i AS m, sqrt(k) AS s FROM k WHERE i = j)
SELECT k.i, k.j, round(k / (x.s * y.s), 6) AS k FROM k JOIN d x ON k.i = x.m JOIN d y ON k.j = y.m
"""
_GAUSS = "exp(-pow((a.x - b.x) / 2.0, 2))"


@register("local_kernel", _LOCAL.format(weights="", value=_GAUSS, on="", join=""))
def _local(spark, folder):
    return _rounded(pairs.local_kernel(_parts(spark, folder), "Gaussian", 2.0), 6, "k")


@register("local_kernel_between", """
WITH a AS (SELECT p_brand AS mol, p_type AS z, p_size / 10 AS x FROM part), b AS (SELECT s_nationkey AS mol, s_suppkey % 50 / 5 AS x FROM supplier),
k AS (SELECT b.mol AS i, a.mol AS j, sum(exp(-pow((a.x - b.x) / 2.0, 2))) AS k FROM b, a GROUP BY 1, 2),
o AS (SELECT a.mol AS m, sqrt(sum(exp(-pow((a.x - c.x) / 2.0, 2)))) AS s FROM a JOIN a c USING (mol) GROUP BY 1), u AS (SELECT b.mol AS m, sqrt(sum(exp(-pow((b.x - c.x) / 2.0, 2)))) AS s FROM b JOIN b c USING (mol) GROUP BY 1)
SELECT i::VARCHAR AS i, j, round(k / (u.s * o.s), 6) AS k FROM k JOIN u ON i = u.m JOIN o ON j = o.m""")
def _between(spark, folder):
    rows = _t(spark, folder, "supplier").select(F.col("s_nationkey").cast("string").alias("mol"), F.lit("any").alias("z"), (F.col("s_suppkey") % 50 / 5).alias("x"))
    return _rounded(pairs.local_kernel_between(rows, _parts(spark, folder), "Gaussian", 2.0), 6, "k")


@register("elemental_kernel", _LOCAL.format(weights="", value=f"CASE WHEN a.z = b.z THEN {_GAUSS} ELSE 0 END", on="", join=""))
def _elemental(spark, folder):
    return _rounded(pairs.local_kernel(_parts(spark, folder), "Gaussian", 2.0, "elemental"), 6, "k")


@register("alchemical_kernel", _LOCAL.format(
    weights=", u AS (SELECT z, row_number() OVER (ORDER BY z) AS n FROM (SELECT DISTINCT z FROM a)), w AS (SELECT p.z AS z1, q.z AS z2, 1.0 / (1 + q.n - p.n) AS w FROM u p JOIN u q ON p.n <= q.n)",
    value=_GAUSS + " * w.w", on="", join=" JOIN w ON w.z1 = least(a.z, b.z) AND w.z2 = greatest(a.z, b.z)"))
def _alchemical(spark, folder):
    atoms = _parts(spark, folder)
    kinds = atoms.select("z").distinct().withColumn("n", F.row_number().over(Window.orderBy("z")))
    weights = kinds.toDF("z1", "n1").join(kinds.toDF("z2", "n2"), F.col("n1") <= F.col("n2")).select("z1", "z2", (1.0 / (1 + F.col("n2") - F.col("n1"))).alias("w"))
    return _rounded(pairs.local_kernel(atoms, "Gaussian", 2.0, "alchemical", weights), 6, "k")


def _nations(spark, folder):
    return _t(spark, folder, "supplier").select(F.col("s_nationkey").cast("string").alias("mol"), F.lit("any").alias("z"), (F.col("s_suppkey") % 50 / 5).alias("x"))


_NORMS = """
WITH RECURSIVE a AS (SELECT p_brand AS mol, p_type AS z, p_size / 10 AS x, p_retailprice AS y FROM part),
b AS (SELECT s_nationkey::VARCHAR AS mol, s_suppkey % 50 / 5 AS x FROM supplier),
o AS (SELECT a.mol AS m, sqrt(sum(exp(-pow((a.x - c.x) / 2.0, 2)))) AS s FROM a JOIN a c USING (mol) GROUP BY 1),
u AS (SELECT b.mol AS m, sqrt(sum(exp(-pow((b.x - c.x) / 2.0, 2)))) AS s FROM b JOIN b c USING (mol) GROUP BY 1),
g AS (SELECT b.mol AS j, a.mol AS i, sum(exp(-pow((a.x - b.x) / 2.0, 2))) / any_value(u.s) / any_value(o.s) AS k
      FROM b CROSS JOIN a JOIN u ON u.m = b.mol JOIN o ON o.m = a.mol GROUP BY 1, 2)"""


@register("local_kernel_predict", _NORMS + """
SELECT j AS mol, round(sum(k * (substr(i, 7)::INTEGER % 7 - 3)), 6) AS alpha, round(sum(k), 6) AS one FROM g GROUP BY 1""")
def _local_predict(spark, folder):
    train = _parts(spark, folder)
    coefficients = train.select("mol").distinct().select("mol", (F.substring("mol", 7, 9).cast("int") % 7 - 3).cast("double").alias("alpha"), F.lit(1.0).alias("one"))
    return _rounded(pairs.local_products(_nations(spark, folder), train, coefficients, ["alpha", "one"], "Gaussian", 2.0), 6, "alpha", "one")


# conjugate gradients on lists: from t(i, y), y by number, and kk(i, r), the rows of the kernel, to the last of cg(n, x)
_CG = """
mm AS (SELECT list(r ORDER BY i) AS k, list(list_avg(r) ORDER BY i) AS m FROM kk),
cc AS (SELECT list_transform(k, lambda r, i: list_transform(r, lambda v, j: v - m[i] - m[j] + list_avg(m))) AS k FROM mm),
cg AS (SELECT 0 AS n, list_transform(y, lambda v: 0.0::DOUBLE) AS x, y AS r, y AS p, list_dot_product(y, y) AS size
       FROM (SELECT list(y - (SELECT avg(y) FROM t) ORDER BY i) AS y FROM t)
  UNION ALL
  SELECT n + 1, x, r, list_transform(list_zip(r, p), lambda z: z[1] + list_dot_product(r, r) / size * z[2]), list_dot_product(r, r) FROM (
    SELECT n, p, size, list_transform(list_zip(x, p), lambda z: z[1] + a * z[2]) AS x, list_transform(list_zip(r, q), lambda z: z[1] - a * z[2]) AS r FROM (
      SELECT *, size / list_dot_product(p, q) AS a FROM (
        SELECT cg.*, list_transform(k, lambda row, i: list_dot_product(row, p) + {lam} * p[i]) AS q FROM cg, cc WHERE n < 400 AND size > 1e-22)))),
best AS (SELECT x AS alpha, list_sum(x) AS whole, m, list_avg(m) AS grand, list_dot_product(m, x) AS columns, (SELECT avg(y) FROM t) AS shift FROM cg, mm ORDER BY n DESC LIMIT 1)"""


@register("local_krr", _NORMS + """,
t AS (SELECT row_number() OVER (ORDER BY mol) AS i, mol, avg(y) AS y FROM a GROUP BY mol),
kk AS (SELECT i, list(k ORDER BY j) AS r FROM (
    SELECT x.i, y.i AS j, sum(exp(-pow((a.x - c.x) / 2.0, 2))) / any_value(p.s) / any_value(q.s) AS k
    FROM a, a c, t x, t y, o p, o q WHERE a.mol = x.mol AND c.mol = y.mol AND p.m = x.mol AND q.m = y.mol GROUP BY 1, 2) GROUP BY 1),
""" + _CG.format(lam=0.01) + """
SELECT g.j AS mol, round(sum(g.k * alpha[t.i]) - avg(g.k) * any_value(whole) - any_value(columns) + any_value(grand * whole) + any_value(shift), 4) AS prediction
FROM g JOIN t ON g.i = t.mol, best GROUP BY 1""")
def _local_krr(spark, folder):
    labels = _t(spark, folder, "part").groupBy(F.col("p_brand").alias("mol")).agg(F.avg("p_retailprice").alias("y"))
    model = ridge.fit_molecules(_parts(spark, folder), labels, "Gaussian", 2.0, 0.01)
    return _rounded(ridge.predict_molecules(model, _nations(spark, folder)), 4, "prediction")


# polynomials of moments on the Spark side, the kernels themselves on the other
@register("local_kernel_scales", """
WITH a AS (SELECT p_brand AS mol, p_type AS z, p_size / 10 AS x FROM part),
s AS (SELECT * FROM (VALUES ('all', 'Gaussian', 0.4), ('all', 'Gaussian', 2.0), ('all', 'Exponential', 0.3), ('all', 'Exponential', 1.5), ('elemental', 'Gaussian', 0.7), ('elemental', 'Exponential', 0.7)) v(mode, kernel, sigma)),
k AS (SELECT mode, kernel, sigma, a.mol AS i, b.mol AS j, sum(CASE WHEN mode = 'all' OR a.z = b.z
             THEN CASE WHEN kernel = 'Gaussian' THEN exp(-pow((a.x - b.x) / sigma, 2)) ELSE exp(-abs(a.x - b.x) / sigma) END ELSE 0 END) AS k
      FROM s, a JOIN a b ON a.mol <= b.mol GROUP BY 1, 2, 3, 4, 5),
d AS (SELECT mode, kernel, sigma, i AS m, sqrt(k) AS s FROM k WHERE i = j)
SELECT k.mode, k.kernel, k.sigma::DOUBLE AS sigma, k.i, k.j, round(k / (x.s * y.s), 6) AS k
FROM k JOIN d x ON k.i = x.m AND (k.mode, k.kernel, k.sigma) = (x.mode, x.kernel, x.sigma) JOIN d y ON k.j = y.m AND (k.mode, k.kernel, k.sigma) = (y.mode, y.kernel, y.sigma)""")
def _scales(spark, folder):
    out = None
    for mode, kernel, sigmas in (("all", "Gaussian", [0.4, 2.0]), ("all", "Exponential", [0.3, 1.5]), ("elemental", "Gaussian", [0.7]), ("elemental", "Exponential", [0.7])):
        part = pairs.local_kernels_of_scales(_parts(spark, folder), kernel, sigmas, mode).select(F.lit(mode).alias("mode"), F.lit(kernel).alias("kernel"), "sigma", "i", "j", "k")
        out = part if out is None else out.unionByName(part)
    return _rounded(out, 6, "k")


_GRID = [0.1, 0.25, 0.5, 0.75, 1.0]


@register("power_moments", """
WITH x AS (SELECT l_returnflag AS i, l_linestatus AS j, l_discount * 10 AS x FROM lineitem), g AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS g, unnest([0, 1, 2, 3, 4]) AS bin),
b AS (SELECT i, j, x, (SELECT min(bin) FROM g WHERE g.g >= x.x) AS bin FROM x), s AS (SELECT i, j, bin, p, sum(pow(x, p)) AS m FROM b, range(5) t(p) WHERE bin IS NOT NULL GROUP BY ALL)
SELECT i, j, bin::INTEGER AS bin, p::INTEGER AS p, round(sum(m) OVER (PARTITION BY i, j, p ORDER BY bin), 4) AS moment FROM s""")
def _moments(spark, folder):
    x = _t(spark, folder, "lineitem").select(F.col("l_returnflag").alias("i"), F.col("l_linestatus").alias("j"), (F.col("l_discount") * 10).alias("x"))
    return _rounded(pairs.power_moments(x, _GRID, 4), 4, "moment")


@register("nearest_anchor", "WITH v AS (SELECT l_linenumber AS anchor, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1) SELECT n::INTEGER AS n, round(min_by(value, (abs(log2(anchor::DOUBLE) - log2(n::DOUBLE)), anchor)), 4) AS value FROM v, (SELECT unnest([1, 3, 5, 9, 40]) AS n) GROUP BY n")
def _anchor(spark, folder):
    v = _t(spark, folder, "lineitem").groupBy(F.col("l_linenumber").alias("anchor")).agg(F.avg("l_extendedprice").alias("value"))
    return _rounded(pairs.nearest_anchor(v, [1, 3, 5, 9, 40]), 4, "value")


@register("anchor_running_min", "WITH v AS (SELECT l_suppkey, l_linenumber, min(l_extendedprice) AS p FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_linenumber, min(p) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) AS least FROM v")
def _running(spark, folder):
    v = _t(spark, folder, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.min("l_extendedprice").alias("p"))
    order = Window.partitionBy("l_suppkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    return v.select("l_suppkey", "l_linenumber", F.min("p").over(order).alias("least"))


# --- molecules ----------------------------------------------------------------------------------------------------

_ATOMS_SQL = """WITH a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS idx,
 l_linenumber::DOUBLE AS z, l_quantity / 10 AS x, l_discount AS y, l_tax AS zc, l_returnflag FROM lineitem)"""


def _atoms(spark, folder):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return _t(spark, folder, "lineitem").select("l_orderkey", F.row_number().over(order).alias("idx"), F.col("l_linenumber").cast("double").alias("z"), (F.col("l_quantity") / 10).alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("zc"), "l_returnflag")


@register("pair_feature", _ATOMS_SQL + """, p AS (SELECT a.l_orderkey, sum(pow(a.z * b.z, 2.5) * exp(-3 * sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.zc - b.zc, 2)))) AS f FROM a JOIN a b ON a.l_orderkey = b.l_orderkey AND a.idx < b.idx GROUP BY 1)
SELECT DISTINCT a.l_orderkey, round(coalesce(f, 0), 4) AS feature FROM a LEFT JOIN p USING (l_orderkey)""")
def _gcp(spark, folder):
    return _rounded(molecules.pair_feature(_atoms(spark, folder), "l_orderkey", "idx"), 4, "feature")


@register("bag_of_distances", _ATOMS_SQL + """, p AS (SELECT a.l_orderkey, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.zc - b.zc, 2)) AS d, least(a.z, b.z) AS p, greatest(a.z, b.z) AS q FROM a JOIN a b ON a.l_orderkey = b.l_orderkey AND a.idx < b.idx),
s AS (SELECT l_orderkey, list(d ORDER BY d) FILTER (p = 1 AND q = 2) AS u, list(d ORDER BY d) FILTER (p = 1 AND q = 3) AS v FROM p GROUP BY 1)
SELECT o.l_orderkey, round(coalesce(u[1], 0), 6) AS first, round(coalesce(v[1], 0), 6) AS second FROM (SELECT DISTINCT l_orderkey FROM a) o LEFT JOIN s USING (l_orderkey)""")
def _bags(spark, folder):
    out = molecules.represent(_atoms(spark, folder), "bag_of_distances", "l_orderkey", index="idx", kinds=[(1.0, 2.0), (1.0, 3.0)], size=2)
    return out.select("l_orderkey", F.round(F.get("v", 0), 6).alias("first"), F.round(F.get("v", 2), 6).alias("second"))


@register("element_matrix", "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS \"A\", count(*) FILTER (l_returnflag = 'N') AS \"N\", count(*) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem GROUP BY 1")
def _elements(spark, folder):
    return molecules.element_matrix(_t(spark, folder, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])


@register("one_hot", "SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS \"o_orderstatus_F\", (o_orderstatus = 'O')::INTEGER AS \"o_orderstatus_O\", (o_orderstatus = 'P')::INTEGER AS \"o_orderstatus_P\" FROM orders")
def _onehot(spark, folder):
    return molecules.one_hot(_t(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"]).drop("o_orderstatus")


_SYMBOL = {"A": "C", "N": "H", "R": "O"}


def _xyz(spark, folder):
    """Orders with a geometry text made of their lines."""
    symbol = F.element_at(F.create_map(*(F.lit(x) for p in _SYMBOL.items() for x in p)), F.col("l_returnflag"))
    line = F.concat_ws(" ", symbol, *(F.col(c).cast("string") for c in ("x", "y", "zc")))
    lines = _atoms(spark, folder).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("l"))
    text = F.concat(F.size("l").cast("string"), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return lines.select(F.col("l_orderkey").alias("o_orderkey"), text.alias("xyz")).join(_t(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@register("xyz_select_label", "WITH c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS c, count(*) FILTER (l_returnflag = 'N') AS h FROM lineitem GROUP BY 1) SELECT o_orderkey, round(o_totalprice / n + c, 7) AS label FROM c JOIN orders ON l_orderkey = o_orderkey WHERE n > 3 AND c >= 1 AND NOT h = 2")
def _xyz_select(spark, folder):
    out = molecules.select_molecules(_xyz(spark, folder), "n_atoms > 3 and n_C >= 1 and not n_H == 2", "o_totalprice / n_atoms + n_C")
    return _rounded(out.select("o_orderkey", "label"), 7, "label")


@register("xyz_atoms", "SELECT CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'N' THEN 'H' ELSE 'O' END AS el, CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 1 ELSE 8 END AS z, count(*) AS n, round(sum(l_quantity / 10), 4) AS x, round(sum(l_tax), 4) AS zc FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def _xyz_atoms(spark, folder):
    atoms = _xyz(spark, folder).select(F.inline(molecules.atoms_of(F.col("xyz"))))
    return _rounded(atoms.groupBy("el", "z").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("zc").alias("zc")), 4, "x", "zc")


@register("select_native", "SELECT o_orderkey, round(o_totalprice / 1000 - o_custkey * 2, 7) AS label FROM orders WHERE (o_totalprice > 150000 OR o_orderstatus IN ('F')) AND NOT o_custkey < 100")
def _select(spark, folder):
    out = molecules.select_molecules(_t(spark, folder, "orders"), "(o_totalprice > 150000 or o_orderstatus in ['F']) and not o_custkey < 100", "o_totalprice / 1000 - `o_custkey` * 2")
    return _rounded(out.select("o_orderkey", "label"), 7, "label")


@register("label_expression", "SELECT vec_id, round(pow(label, 2) / nullif(label - 3, 0) + vec_id % 7, 6) AS label FROM embeddings")
def _label(spark, folder):
    return _t(spark, folder, "embeddings").select("vec_id", F.round(select_column("label ** 2 / (label - 3) + vec_id % 7"), 6).alias("label"))


@register("json_scan", "SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def _json(spark, folder):
    k = F.from_json("props", "k bigint")["k"]
    return _t(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@register("charges", "SELECT c_custkey, round(c_acctbal)::INTEGER AS charge, 1 AS spin_multiplicity FROM customer")
def _charges(spark, folder):
    return molecules.charges(_t(spark, folder, "customer").select("c_custkey", F.round("c_acctbal").alias("charge")))


@register("append_unlabelled", "SELECT c_nationkey AS k, c_acctbal AS label, false AS is_predict FROM customer UNION ALL SELECT s_nationkey, NULL, true FROM supplier")
def _append(spark, folder):
    main = _t(spark, folder, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("label"))
    return molecules.append_unlabelled(main, _t(spark, folder, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("label")))


@register("unseen_values", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _unseen(spark, folder):
    orders = _t(spark, folder, "orders")
    side = lambda f: orders.where(F.col("o_orderstatus") == f).select(F.col("o_custkey").alias("k")).distinct()
    return side("P").join(side("F"), "k", "left_anti")


# --- detrending, splits, learning curves --------------------------------------------------------------------------


@register("detrend_categorical", "SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderstatus), 3) AS residual FROM orders")
def _detrend(spark, folder):
    rows = molecules.one_hot(_t(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", ["F", "O", "P"]).withColumn("one", F.lit(1))
    return _rounded(regression.detrend(rows, ["one", "o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P"], "o_totalprice").select("o_orderkey", "residual"), 3, "residual")


@register("detrend_linear", "WITH c AS (SELECT regr_slope(c_acctbal, c_custkey) AS a, regr_intercept(c_acctbal, c_custkey) AS b FROM customer) SELECT c_custkey, round(c_acctbal - a * c_custkey - b, 4) AS residual FROM customer, c")
def _linear(spark, folder):
    rows = _t(spark, folder, "customer").select("c_custkey", "c_acctbal", F.lit(1).alias("one"))
    return _rounded(regression.detrend(rows, ["one", "c_custkey"], "c_acctbal").select("c_custkey", "residual"), 4, "residual")


@register("null_model", "WITH m AS (SELECT avg(o_totalprice) AS m FROM orders WHERE o_orderkey % 5 <> 0) SELECT o_orderkey % 5 <> 0 AS is_train, round(sqrt(avg(pow(o_totalprice - m, 2))), 4) AS rmse, round(avg(abs(o_totalprice - m)), 4) AS mae FROM orders, m GROUP BY 1")
def _null(spark, folder):
    return _rounded(regression.null_model(_t(spark, folder, "orders"), "o_totalprice", "o_orderkey % 5 <> 0"), 4, "rmse", "mae")


@register("holdout_split", "SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || ':7'), o_orderkey) <= 1000 AS is_train FROM orders")
def _holdout(spark, folder):
    return sampling.holdout_split(_t(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 1000, "7")


@register("cross_validation", """
WITH s AS (SELECT c_custkey, c_acctbal, k AS split, row_number() OVER (PARTITION BY k ORDER BY md5(c_custkey::VARCHAR || ':' || k::VARCHAR), c_custkey) <= floor((SELECT count(*) FROM customer) * 0.2) AS v FROM customer, range(10) t(k))
SELECT split::INTEGER AS split, count(*) AS n, round(median(c_acctbal), 4) AS m FROM s WHERE v GROUP BY 1""")
def _cv(spark, folder):
    out = sampling.cross_validation(_t(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 10).where("is_validation")
    return _rounded(out.groupBy("split").agg(F.count("*").alias("n"), F.median("c_acctbal").alias("m")), 4, "m")


@register("sample_fraction", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || ':5'), o_orderkey LIMIT (SELECT round_even(count(*) * 0.3, 0)::BIGINT FROM orders)")
def _fraction(spark, folder):
    return sampling.fraction(_t(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 0.3, "5")


_UNIFORM = "((('0x' || substr(md5({}), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656"


@register("multinomial", f"""
WITH w AS (SELECT s_suppkey, abs(s_acctbal) + 1 AS w FROM supplier), c AS (SELECT s_suppkey, w, sum(w) OVER (ORDER BY s_suppkey) AS h, sum(w) OVER () AS t FROM w),
d AS (SELECT {_UNIFORM.format("k::VARCHAR || ':0'")} AS u FROM range(20000) t(k))
SELECT s_suppkey, count(*) AS times FROM c JOIN d ON u >= (h - w) / t AND u < h / t GROUP BY 1""")
def _multinomial(spark, folder):
    rows = _t(spark, folder, "supplier").select("s_suppkey", (F.abs("s_acctbal") + 1).alias("w"))
    return sampling.multinomial(rows, "s_suppkey", "w", 20000)


@register("sample_fixed_size", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || ':3'), o_orderkey LIMIT 500")
def _sample(spark, folder):
    return sampling.sample(_t(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 500, "3")


@register("stratified_sample", "WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR || ':0'), c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n, count(*) OVER () AS t FROM customer) SELECT c_custkey, c_nationkey FROM r WHERE r <= greatest(1, round(200 * n / t))")
def _stratified(spark, folder):
    return sampling.stratified(_t(spark, folder, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", 200)


@register("weighted_choice", f"""
WITH r AS (SELECT p_partkey, k AS draw, ln(-ln({_UNIFORM.format("p_partkey::VARCHAR || ':' || k::VARCHAR || ':0'")})) - ln(p_retailprice::DOUBLE) AS t FROM part, range(50) t(k))
SELECT draw::INTEGER AS draw, min_by(p_partkey, (t, p_partkey)) AS p_partkey FROM r GROUP BY 1""")
def _weighted(spark, folder):
    return sampling.weighted_choice(_t(spark, folder, "part"), "p_partkey", "p_retailprice", 50)


@register("curve_summary", "SELECT l_linenumber, round(median(l_extendedprice), 4) AS l_extendedprice_median, round(quantile_cont(l_extendedprice, 0.33), 4) AS l_extendedprice_p33, round(quantile_cont(l_extendedprice, 0.67), 4) AS l_extendedprice_p67, round(median(l_quantity), 4) AS l_quantity_median, round(quantile_cont(l_quantity, 0.33), 4) AS l_quantity_p33, round(quantile_cont(l_quantity, 0.67), 4) AS l_quantity_p67 FROM lineitem WHERE l_linenumber > 1 GROUP BY 1")
def _curve(spark, folder):
    out = stats.curve_summary(_t(spark, folder, "lineitem"), "l_linenumber", ["l_extendedprice", "l_quantity"])
    return _rounded(out, 4, *out.columns[1:])


@register("best_hyperparameters", "WITH m AS (SELECT l_linenumber AS ntrain, l_discount AS sigma, l_tax AS lam, median(l_extendedprice) AS rmse FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) >= 5), r AS (SELECT *, row_number() OVER (PARTITION BY ntrain ORDER BY rmse, sigma, lam) AS k FROM m) SELECT ntrain, sigma, lam, round(rmse, 4) AS rmse FROM r WHERE k = 1")
def _best(spark, folder):
    rows = _t(spark, folder, "lineitem").select(F.col("l_linenumber").alias("ntrain"), F.col("l_discount").alias("sigma"), F.col("l_tax").alias("lam"), F.col("l_extendedprice").alias("rmse"))
    return _rounded(stats.best_hyperparameters(rows), 4, "rmse")


@register("hyperparameter_grid", "SELECT l_discount AS sigma, " + ", ".join(f"round(median(l_extendedprice) FILTER (l_tax = {k / 100}), 4) AS lam_{k}" for k in range(9)) + " FROM lineitem GROUP BY 1")
def _grid(spark, folder):
    rows = _t(spark, folder, "lineitem").withColumn("lam", F.round(F.col("l_tax") * 100).cast("int"))
    out = rows.groupBy(F.col("l_discount").alias("sigma")).pivot("lam", list(range(9))).agg(F.median("l_extendedprice"))
    return _rounded(out.toDF("sigma", *(f"lam_{k}" for k in range(9))), 4, *(f"lam_{k}" for k in range(9)))


@register("curve_slope", "WITH p AS (SELECT l_returnflag, l_linenumber, avg(l_extendedprice) AS e FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linenumber, round((ln(e) - lag(ln(e)) OVER w) / (ln(l_linenumber) - lag(ln(l_linenumber)) OVER w), 6) AS slope FROM p WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_linenumber)")
def _slope(spark, folder):
    p = _t(spark, folder, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_extendedprice").alias("e"))
    return _rounded(stats.curve_slope(p, "l_linenumber", "e", ["l_returnflag"]).drop("e"), 6, "slope")


@register("convergence", "SELECT l_suppkey, count(*) AS n, count(*) > 5 AND abs(median(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END) - median(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice END)) / median(l_extendedprice) < 0.05 AS converged FROM lineitem GROUP BY 1")
def _converged(spark, folder):
    return stats.converged(_t(spark, folder, "lineitem"), ["l_suppkey"], "l_linenumber", "l_extendedprice").select("l_suppkey", "n", "converged")


@register("metadata_agreement", "SELECT unnest(['c_mktsegment', 'c_nationkey']) AS field, unnest([count(DISTINCT c_mktsegment), count(DISTINCT c_nationkey)]) AS values, unnest([count(DISTINCT c_mktsegment) <= 1, count(DISTINCT c_nationkey) <= 1]) AS agree FROM customer")
def _metadata(spark, folder):
    return stats.comparable(_t(spark, folder, "customer"), ["c_mktsegment", "c_nationkey"])


# --- distributions ------------------------------------------------------------------------------------------------

_MERGED = """WITH a AS (SELECT l_partkey AS k, count(*) AS f FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS f FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
m AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.f, 0) AS f1, coalesce(b.f, 0) AS f2 FROM a FULL JOIN b ON a.k = b.k),
w AS (SELECT *, f1 / sum(f1) OVER () AS w1, f2 / sum(f2) OVER () AS w2, (f1 + f2) / sum(f1 + f2) OVER () AS w FROM m)"""


def _merged(spark, folder):
    line = _t(spark, folder, "lineitem")
    side = lambda f: line.where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("freq"))
    return stats.merge_frequencies(side("A"), side("R"), "k")


@register("relative_weights", _MERGED + " SELECT k, f1, f2, round(w1, 9) AS w1, round(w2, 9) AS w2, round(w, 9) AS w FROM w")
def _weights(spark, folder):
    return _rounded(stats.relative_weights(_merged(spark, folder)), 9, "w1", "w2", "w")


@register("distribution_distances", _MERGED + """,
c AS (SELECT *, sum(w1 + 1e-10) OVER o AS c1, sum(w2 + 1e-10) OVER o AS c2 FROM w WINDOW o AS (ORDER BY k)), t AS (SELECT sum(w1 + 1e-10) AS p, sum(w2 + 1e-10) AS q FROM w),
z AS (SELECT max(abs(c1 - c2)) AS ks, sum((w1 + 1e-10) / p * ln(((w1 + 1e-10) / p) / ((w2 + 1e-10) / q))) AS kl, sum(abs(c1 - c2)) - (min_by(abs(c1 - c2), k) + max_by(abs(c1 - c2), k)) / 2 AS area,
  sum(c1) - (min_by(c1, k) + max_by(c1, k)) / 2 AS area_one, sum(c2) - (min_by(c2, k) + max_by(c2, k)) / 2 AS area_two FROM c, t)
SELECT round(ks, 8) AS ks, round(kl, 6) AS kl, round(area, 6) AS area, round(area_one, 6) AS area_one, round(area_two, 6) AS area_two, round(area / greatest(area_one, area_two) * 100, 6) AS percent FROM z""")
def _distances(spark, folder):
    out = stats.distances(_merged(spark, folder), "k")
    return out.select(_r("ks", 8), *(_r(c) for c in out.columns[1:]))


@register("two_sample_ks", "WITH c AS (SELECT value AS x, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY 1) SELECT round(max(g), 8) AS ks FROM (SELECT abs(sum(a) OVER (ORDER BY x) / (SELECT sum(a) FROM c) - sum(b) OVER (ORDER BY x) / (SELECT sum(b) FROM c)) AS g FROM c)")
def _ks2(spark, folder):
    x = _t(spark, folder, "events").select((F.col("user_id") % 2 + 1).alias("side"), F.col("value").alias("x"))
    return stats.two_sample_ks(x).select(_r("ks", 8))


_TIMES = "len(list_filter([" + ", ".join(repr(c) for c in stats.POISSON) + "]::DOUBLE[], lambda c: c <= u))"


@register("bootstrap_interval", _MERGED + f""",
u AS (SELECT k, f1, f2, r, {_UNIFORM.format("k::VARCHAR || ':' || r::VARCHAR || ':0'")} AS u FROM m, range(1000) t(r)), d AS (SELECT *, {_TIMES} AS n FROM u),
s AS (SELECT r, sum(f1 * n) AS t1, sum(f2 * n) AS t2 FROM d GROUP BY 1),
p AS (SELECT d.*, f1 / t1 + 1e-10 AS p1, f2 / t2 + 1e-10 AS p2 FROM d JOIN s USING (r) WHERE n > 0),
c AS (SELECT *, abs(sum(n * p1) OVER o - sum(n * p2) OVER o) AS gap, sum(n * p1) OVER (PARTITION BY r) AS a, sum(n * p2) OVER (PARTITION BY r) AS b FROM p WINDOW o AS (PARTITION BY r ORDER BY k)),
q AS (SELECT r, max(gap) AS ks, sum(n * p1 / a * ln((p1 / a) / (p2 / b))) AS kl FROM c GROUP BY 1)
SELECT """ + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(quantile_cont({m}, 0.025), 6) AS {m}_low, round(quantile_cont({m}, 0.975), 6) AS {m}_high" for m in ("ks", "kl")) + " FROM q")
def _bootstrap(spark, folder):
    out = stats.bootstrap_summary(stats.bootstrap(_merged(spark, folder), "k", 1000), ["ks", "kl"])
    return _rounded(out, 6, *out.columns)


@register("log_metrics", "SELECT p_partkey, round(log10(p_size), 8) AS log_p_size, round(greatest(log10(p_size), log10(p_retailprice)), 8) AS log_larger FROM part")
def _log_metrics(spark, folder):
    out = stats.log_metrics(_t(spark, folder, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size"], {"larger": ("p_size", "p_retailprice")})
    return _rounded(out.select("p_partkey", "log_p_size", "log_larger"), 8, "log_p_size", "log_larger")


@register("capped_metrics", "SELECT o_orderkey, round(least(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.9) FROM orders)), 4) AS o_totalprice FROM orders")
def _capped(spark, folder):
    return _rounded(stats.capped(_t(spark, folder, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice"), 4, "o_totalprice")


_NUCLEI = """WITH a AS (SELECT l_orderkey AS mol, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i,
  l_linenumber::DOUBLE AS q, l_quantity / 10 AS x, l_discount AS y, l_tax AS w, l_partkey % 4 - 1.5 AS d FROM lineitem),
n AS (SELECT mol, i, q, x, y, w + i AS z, CASE WHEN i % 2 = 1 THEN d END AS d FROM a),
p AS (SELECT a.mol, a.i AS ai, b.i AS bi, a.q AS aq, b.q AS bq, a.d AS ad, b.d AS bd, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS r
  FROM n a JOIN n b ON a.mol = b.mol AND a.i <> b.i),
m AS (SELECT DISTINCT mol FROM n)
"""


def _nuclei(spark, folder):
    """Lines as nuclei of their order, and changes of the charges of every other one."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = _t(spark, folder, "lineitem").withColumn("i", F.row_number().over(order))
    atoms = rows.select(F.col("l_orderkey").alias("mol"), "i", F.col("l_linenumber").cast("double").alias("q"), (F.col("l_quantity") / 10).alias("x"), F.col("l_discount").alias("y"), (F.col("l_tax") + F.col("i")).alias("z"))
    return atoms, rows.where("i % 2 = 1").select(F.col("l_orderkey").alias("mol"), "i", (F.col("l_partkey") % 4 - 1.5).cast("double").alias("d"))


@register("nuclear_charges", _NUCLEI + """SELECT m.mol, round(coalesce(sum(aq * bq / r) FILTER (ai < bi), 0), 4) AS repulsion, round(coalesce(sum(aq * bd / r), 0), 4) AS first,
  round(coalesce(2 * sum(ad * bd / r) FILTER (ai < bi), 0), 4) AS second FROM m LEFT JOIN p USING (mol) GROUP BY 1""")
def _nuclear(spark, folder):
    atoms, changes = _nuclei(spark, folder)
    whole = lambda df, name: df.withColumnRenamed("value", name)
    out = whole(nuclear.repulsion(atoms), "repulsion").join(whole(nuclear.charge_derivative(atoms, changes), "first"), "mol").join(whole(nuclear.charge_second_derivative(atoms, changes), "second"), "mol")
    return _rounded(out, 4, "repulsion", "first", "second")


@register("nuclear_gradient", _NUCLEI + """SELECT n.mol, n.i, """ + ", ".join(f"round(coalesce(sum(aq * bq * d{x} / pow(r, 3)), 0), 4) + 0.0 AS g{x}, round(coalesce(sum((aq * coalesce(bd, 0) + bq * coalesce(ad, 0)) * d{x} / pow(r, 3)), 0), 4) + 0.0 AS h{x}" for x in "xyz") + """
  FROM n LEFT JOIN p ON p.mol = n.mol AND p.bi = n.i GROUP BY 1, 2""")
def _nuclear_gradient(spark, folder):
    atoms, changes = _nuclei(spark, folder)
    changed = nuclear.gradient_charge_derivative(atoms, changes).toDF("mol", "i", "hx", "hy", "hz")
    return nuclear.gradient(atoms).join(changed, ["mol", "i"]).select("mol", "i", *((F.round(c, 4) + 0.0).alias(c) for c in ("gx", "gy", "gz", "hx", "hy", "hz")))


@register("select_shells", """
WITH b AS (SELECT p_type AS element, p_partkey AS shell, p_size % 2 AS l, p_retailprice AS exp FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY element, l ORDER BY shell) AS r FROM b),
k AS (SELECT *, CASE WHEN element = 'SMALL' THEN 0 ELSE l END AS o FROM r WHERE element = 'SMALL' OR r <= CASE l WHEN 0 THEN 3 ELSE 2 END)
SELECT element, shell, l::INTEGER AS l, exp, (row_number() OVER (PARTITION BY element ORDER BY o, shell) - 1)::INTEGER AS place FROM k""")
def _shells(spark, folder):
    rows = _t(spark, folder, "part").select(F.col("p_type").alias("element"), F.col("p_partkey").alias("shell"), (F.col("p_size") % 2).cast("int").alias("l"), F.col("p_retailprice").alias("exp"), F.lit(1.0).alias("coef"))
    return basis.select_shells(rows, "SSSPP", ("SMALL",)).select("element", "shell", "l", "exp", F.col("place").cast("int").alias("place"))


@register("sampled_divergences", """
WITH c AS (SELECT l_suppkey AS k, count(*) FILTER (l_returnflag = 'A') AS f1, count(*) FILTER (l_returnflag = 'R') AS f2 FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY md5(k || ':4'), k) AS p, count(*) OVER () AS n FROM c),
s AS (SELECT share, k, f1, f2, sum(f1) OVER w AS t1, sum(f2) OVER w AS t2 FROM r JOIN (VALUES (0.3::DOUBLE), (0.6::DOUBLE), (1.0::DOUBLE)) v(share) ON p <= round(share * n) WINDOW w AS (PARTITION BY share)),
q AS (SELECT share, f1 / t1 + 1e-10 AS p, f2 / t2 + 1e-10 AS q FROM s),
d AS (SELECT share, count(*) AS n, sum(p * ln(p / q)) / sum(p) - ln(sum(p) / sum(q)) AS kl, sum(q * ln(q / p)) / sum(q) - ln(sum(q) / sum(p)) AS reverse_kl FROM q GROUP BY 1),
x AS (SELECT share, f1 AS x, 1 AS a, 0 AS b FROM s UNION ALL SELECT share, f2, 0, 1 FROM s), y AS (SELECT share, x, sum(a) AS a, sum(b) AS b FROM x GROUP BY 1, 2),
z AS (SELECT share, abs(sum(a) OVER (PARTITION BY share ORDER BY x) - sum(b) OVER (PARTITION BY share ORDER BY x)) AS gap, sum(a) OVER (PARTITION BY share) AS n FROM y)
SELECT share, d.n, round(max(gap / z.n), 6) AS ks, round(any_value(kl), 6) AS kl, round(any_value(reverse_kl), 6) AS reverse_kl FROM d JOIN z USING (share) GROUP BY 1, 2""")
def _sampled(spark, folder):
    line = _t(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count_if(F.col("l_returnflag") == "A").alias("f1"), F.count_if(F.col("l_returnflag") == "R").alias("f2"))
    return _rounded(stats.sampled_divergences(line, "k", [0.3, 0.6, 1.0], "4"), 6, "ks", "kl", "reverse_kl")


@register("weighted_sums", "SELECT l_suppkey AS mol, round(sum(l_linenumber * l_quantity), 4) AS a, round(sum(l_linenumber * l_discount), 4) AS b, round(sum(l_linenumber * l_tax), 4) AS c FROM lineitem GROUP BY 1")
def _weighted_sums(spark, folder):
    atoms = _t(spark, folder, "lineitem").select(F.col("l_suppkey").alias("mol"), F.array("l_quantity", "l_discount", "l_tax").alias("v"), F.col("l_linenumber").alias("w"))
    return molecules.weighted_sums(atoms, "mol", weight="w").select("mol", *(F.round(F.get("v", F.lit(k)), 4).alias(c) for k, c in enumerate("abc")))


# orders written as files of a published data set and read by its converter; every seventh is on the list of those left out
@register("qm9_rows", """
WITH a AS (SELECT l_orderkey AS k, count(*) AS n, string_agg(CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'H' END || ' ' || l_linenumber || ' 0 1.5e-1', chr(10) ORDER BY l_linenumber, l_quantity) AS t,
  count(*) FILTER (l_linenumber % 2 = 0) AS c, count(*) FILTER (l_linenumber % 2 = 1) AS h FROM lineitem GROUP BY 1)
SELECT 'gdb' || k AS id, n || chr(10) || chr(10) || t AS xyz, round(k + 10 + 0.25, 4)::DOUBLE AS totalenergy, round(k + 10.25 + h * 0.500273 + c * 37.846772, 4)::DOUBLE AS atomisation_energy, (k + 0.25)::DOUBLE AS A, 0.0325::DOUBLE AS mu
FROM a WHERE k % 7 > 0""")
def _qm9(spark, folder):
    atom = F.concat_ws(" ", F.when(F.col("l_linenumber") % 2 == 0, "C").otherwise("H"), F.col("l_linenumber").cast("string"), F.lit("0"), F.lit("1.5*^-1"))
    rows = _t(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", atom.alias("a")))).alias("r"))
    first = F.concat_ws(" ", F.concat(F.lit("gdb"), F.col("k").cast("string")), F.col("k").cast("string"), F.concat("k", F.lit(".25")), F.lit("1"), F.lit("1"), F.lit("3.25*^-2"), *(F.lit("2"),) * 6, F.concat((F.col("k") + 10).cast("string"), F.lit(".25")), *(F.lit("4"),) * 4)
    content = F.concat_ws("\n", F.col("n").cast("string"), first, F.transform("r", lambda x: x["a"]), F.lit("rest"))
    excluded = rows.where("k % 7 = 0").select(F.concat(F.lit("gdb"), F.col("k").cast("string")).alias("id"))
    out = datasets.qm9_molecules(rows.select(content.alias("content")), excluded)
    return out.select("id", "xyz", _r("totalenergy", 4), _r("atomisation_energy", 4), "A", "mu")


# --- chemical space -----------------------------------------------------------------------------------------------

_TYPES = [("C", 4), ("H", 1), ("O", 2), ("F", 1)]


def _sizes(spark, folder):
    n = _t(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("natoms"))
    return n.groupBy("natoms").agg(F.count("*").alias("orders"))


_CASES = """WITH s AS (SELECT natoms, count(*) AS orders FROM (SELECT count(*) AS natoms FROM lineitem GROUP BY l_orderkey) GROUP BY 1),
c AS (SELECT natoms, orders, c, h, o, natoms - c - h - o AS f FROM s, range(14) c(c), range(14) h(h), range(14) o(o) WHERE c + h + o <= natoms AND (4*c + 2*o + h + natoms - c - h - o) % 2 = 0
 AND 2 * CASE WHEN c > 0 THEN 4 WHEN o > 0 THEN 2 ELSE 1 END <= 4*c + 2*o + natoms - c - o AND (4*c + 2*o + natoms - c - o) / 2 - (natoms - 1) >= 0)"""


@register("enumerate_cases", _CASES + " SELECT natoms::INTEGER AS natoms, any_value(orders) AS orders, count(*) AS cases, sum(c)::BIGINT AS carbons FROM c GROUP BY natoms")
def _cases(spark, folder):
    c = space.enumerate_cases(_sizes(spark, folder), _TYPES)
    carbons = F.coalesce(F.try_element_at(space.counts_of(F.col("stoichiometry")), F.lit("C")), F.lit(0))
    return c.groupBy("natoms").agg(F.first("orders").alias("orders"), F.count("*").alias("cases"), F.sum(carbons).alias("carbons"))


@register("select_cases", _CASES + " SELECT natoms::INTEGER AS natoms, count(*) AS cases FROM c WHERE (c + o < h + 2 AND NOT f = 0) OR natoms = 3 GROUP BY natoms")
def _select_cases(spark, folder):
    c = space.select_cases(space.enumerate_cases(_sizes(spark, folder), _TYPES), "(C + O < H + 2 & not F = 0) | # = 3")
    return c.groupBy("natoms").agg(F.count("*").alias("cases"))


@register("degree_sequences", _CASES + " SELECT natoms::INTEGER AS natoms, count(DISTINCT (c, o)) AS sequences FROM c GROUP BY natoms")
def _sequences(spark, folder):
    c = space.enumerate_sequences(_sizes(spark, folder), _TYPES, pure=True)
    return c.groupBy("natoms").agg(F.count("*").alias("sequences"))


@register("degree_multisets", _CASES + """ SELECT natoms::INTEGER AS natoms, concat_ws('_', CASE WHEN least(h, f) > 0 THEN '1.' || least(h, f) END, CASE WHEN greatest(h, f) > 0 THEN '1.' || greatest(h, f) END,
  CASE WHEN o > 0 THEN '2.' || o END, CASE WHEN c > 0 THEN '4.' || c END) AS label FROM c GROUP BY 1, 2""")
def _multisets(spark, folder):
    c = space.enumerate_sequences(_sizes(spark, folder), _TYPES)
    return c.select("natoms", formulas.label_text(F.col("sequence")).alias("label"))


@register("draw_cases", """
WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A' AND l_linenumber % 2 = 1) AS p, count(*) FILTER (l_returnflag = 'A' AND l_linenumber % 2 = 0) AS q,
  count(*) FILTER (l_returnflag = 'N') AS h, count(*) FILTER (l_returnflag = 'R') AS o FROM lineitem GROUP BY 1),
e AS (SELECT concat_ws('', CASE WHEN h = 1 THEN 'H' WHEN h > 1 THEN 'H' || h END, CASE WHEN o = 1 THEN 'O' WHEN o > 1 THEN 'O' || o END, CASE WHEN p + q = 1 THEN 'P' WHEN p + q > 1 THEN 'P' || (p + q) END) AS formula,
  '[' || concat_ws(',', CASE WHEN h > 0 THEN '{"label":"H","valence":1,"count":' || h || '}' END, CASE WHEN o > 0 THEN '{"label":"O","valence":2,"count":' || o || '}' END,
  CASE WHEN p > 0 THEN '{"label":"P","valence":3,"count":' || p || '}' END, CASE WHEN q > 0 THEN '{"label":"P","valence":5,"count":' || q || '}' END) || ']' AS text, count(*) AS n FROM c GROUP BY 1, 2),
f AS (SELECT formula, sum(n) AS n FROM e GROUP BY 1),
g AS (SELECT formula, sum(n) OVER (ORDER BY formula) AS b, n, sum(n) OVER () AS t FROM f),
i AS (SELECT formula, text, sum(n) OVER (PARTITION BY formula ORDER BY text) AS b, n, sum(n) OVER (PARTITION BY formula) AS t FROM e),
u AS (SELECT d AS draw, (('0x' || substr(md5(d || ':9:formula'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
  (('0x' || substr(md5(d || ':9:case'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS v FROM range(20000) r(d))
SELECT draw, g.formula, i.text FROM u JOIN g ON u.u >= (g.b - g.n)::DOUBLE / g.t::DOUBLE AND u.u < g.b::DOUBLE / g.t::DOUBLE
JOIN i ON i.formula = g.formula AND u.v >= (i.b - i.n)::DOUBLE / i.t::DOUBLE AND u.v < i.b::DOUBLE / i.t::DOUBLE""")
def _draws(spark, folder):
    line = _t(spark, folder, "lineitem")
    n = lambda test: F.count_if(F.expr(test)).cast("int")
    atoms = line.groupBy("l_orderkey").agg(
        n("l_returnflag = 'N'").alias("H"), n("l_returnflag = 'R'").alias("O"), n("l_returnflag = 'A' AND l_linenumber % 2 = 1").alias("P"), n("l_returnflag = 'A' AND l_linenumber % 2 = 0").alias("Q"))
    types = (("H", "H", 1), ("O", "O", 2), ("P", "P", 3), ("Q", "P", 5))
    stoichiometry = F.filter(F.array(*(F.struct(F.lit(label).alias("label"), F.lit(v).alias("valence"), F.col(c).alias("count")) for c, label, v in types)), lambda t: t["count"] > 0)
    counted = atoms.groupBy(stoichiometry.alias("stoichiometry")).agg(F.count("*").alias("n")).withColumn("label", space.label_of(F.col("stoichiometry")))
    drawn = space.draw_cases(counted, 20_000, "9")
    return drawn.select("draw", "formula", F.to_json("stoichiometry").alias("text"))


_COUNTS = "WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) AS t FROM lineitem GROUP BY 1)"


def _compositions(spark, folder):
    """Per order its stoichiometry: C of valence 4, H of 1, O of 2."""
    m = molecules.element_matrix(_t(spark, folder, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])
    atom = lambda c, label, v: F.struct(F.lit(label).alias("label"), F.lit(v).alias("valence"), F.col(c).cast("int").alias("count"))
    return m.select("l_orderkey", F.filter(F.array(atom("A", "C", 4), atom("N", "H", 1), atom("R", "O", 2)), lambda x: x["count"] > 0).alias("stoichiometry"))


@register("composition_predicate", _COUNTS + " SELECT l_orderkey FROM c WHERE (a = 1 AND n = 1) OR NOT (r < a + 1 OR t > 6)")
def _predicate(spark, folder):
    return space.select_cases(_compositions(spark, folder), "C = 1 & H = 1 | not (O < C + 1 | # > 6)").select("l_orderkey")


_PART = "CASE {n} WHEN 0 THEN '' WHEN 1 THEN '{s}' ELSE '{s}' || {n} END"
_HILL = " || ".join(_PART.format(n=n, s=s) for n, s in (("a", "C"), ("n", "H"), ("r", "O")))


@register("sum_formula", _COUNTS + f" SELECT l_orderkey, {_HILL} AS formula FROM c")
def _formula(spark, folder):
    return _compositions(spark, folder).select("l_orderkey", formulas.sum_formula(F.col("stoichiometry")).alias("formula"))


@register("ordered_formula", _COUNTS + " SELECT l_orderkey, " + " || ".join(_PART.format(n=n, s=s) for n, s in (("(2 * a)", "C"), ("n", "H"), ("r", "O"))) + " AS formula, concat_ws(' & ', CASE WHEN a > 0 THEN 'C = ' || a END, CASE WHEN n > 0 THEN 'H = ' || n END, CASE WHEN r > 0 THEN 'O = ' || r END) AS criterion FROM c")
def _ordered(spark, folder):
    rows = _compositions(spark, folder).select("l_orderkey", formulas.sum_formula(F.col("stoichiometry")).alias("f"))
    twice = F.concat("f", F.regexp_extract("f", "^(C[0-9]*)", 1))
    return rows.select("l_orderkey", formulas.ordered_formula(twice).alias("formula"), formulas.criterion(F.col("f")).alias("criterion"))


@register("canonical_label", _COUNTS + " SELECT l_orderkey, concat_ws('_', CASE WHEN n > 0 THEN '1.' || n END, CASE WHEN r > 0 THEN '2.' || r END, CASE WHEN a > 0 THEN '4.' || a END) AS label FROM c")
def _canonical(spark, folder):
    rows = _compositions(spark, folder).select("l_orderkey", space.label_of(F.col("stoichiometry")).alias("label"))
    return rows.select("l_orderkey", formulas.label_text(formulas.pure_label(formulas.parse_label(F.col("label")))).alias("label"))


@register("ln_asymptotic", _COUNTS + """, m AS (SELECT *, (4*a + 2*r + n)::DOUBLE AS m1, (12*a + 2*r)::DOUBLE AS m2, (24*a)::DOUBLE AS m3 FROM c)
SELECT l_orderkey, round(lgamma(m1 + 1) - lgamma(m1 // 2 + 1) - (m1 // 2) * ln(2) - a * ln(24) - r * ln(2) - m2 / (2*m1) + m2*m2 / (4*m1*m1) + pow(m2, 4) / (4*pow(m1, 5)) - m2*m2*m3 / (2*pow(m1, 4)) + m3*m3 / (6*pow(m1, 3)), 6) AS ln_count FROM m WHERE m1 % 2 = 0""")
def _asymptotic(spark, folder):
    s = space.degree_sequence(F.col("stoichiometry"))
    even = F.aggregate("s", F.lit(0), lambda a, p: a + p["deg"] * p["cnt"]) % 2 == 0
    return _compositions(spark, folder).select("l_orderkey", s.alias("s")).where(even).select("l_orderkey", F.round(formulas.ln_asymptotic(F.col("s")), 6).alias("ln_count"))


_KNOWN = ", l AS (SELECT *, concat_ws('_', CASE WHEN n > 0 THEN '1.' || n END, CASE WHEN r > 0 THEN '2.' || r END, CASE WHEN a > 0 THEN '4.' || a END) AS label FROM c), g AS (SELECT label, count(*) AS n, avg(t) AS q FROM l GROUP BY 1)"


def _tables(spark, folder):
    """Cases, and a table of exact counts of their frequent labels."""
    cases = cut(_compositions(spark, folder).withColumn("label", space.label_of(F.col("stoichiometry"))))
    labels = cases.groupBy("label").agg(F.count("*").alias("n"))
    return cases.drop("label"), labels.where("n >= 40")


def _mixed(spark, folder):
    """Orders, and parts with some dozens of lines, as compositions of C, O and two elements of valence 1, of even valence."""
    kind = F.when(F.col("l_returnflag") == "A", "C").when(F.col("l_returnflag") == "R", "O").when(F.col("l_linenumber") % 2 == 1, "H").otherwise("F")
    line = _t(spark, folder, "lineitem").withColumn("el", kind)
    side = lambda c: line.select(F.concat(F.lit(c), F.col(c).cast("string")).alias("id"), "el")
    m = molecules.element_matrix(side("l_orderkey").unionByName(side("l_partkey")), "id", "el", ["C", "O", "H", "F"])
    atom = lambda label, v: F.struct(F.lit(label).alias("label"), F.lit(v).alias("valence"), F.col(label).cast("int").alias("count"))
    return m.where("(H + F) % 2 = 0").select("id", F.filter(F.array(atom("C", 4), atom("O", 2), atom("H", 1), atom("F", 1)), lambda x: x["count"] > 0).alias("stoichiometry"))


_TERM = "CASE WHEN {n} > 0 THEN '{d}.' || {n} END"
_LABEL = "concat_ws('_', {}, " + ", ".join(_TERM.format(n=n, d=d) for n, d in (("o", 2), ("c", 4))) + ")"


@register("count_fallback", f"""
WITH x AS (SELECT 'o' || l_orderkey AS id, l_returnflag AS f, l_linenumber % 2 AS k FROM lineitem UNION ALL SELECT 'p' || l_partkey, l_returnflag, l_linenumber % 2 FROM lineitem),
c AS (SELECT id, count(*) FILTER (f = 'A') AS c, count(*) FILTER (f = 'R') AS o, count(*) FILTER (f = 'N' AND k = 1) AS h, count(*) FILTER (f = 'N' AND k = 0) AS f FROM x GROUP BY id),
l AS (SELECT *, h + f AS t, 4 * c + 2 * o + h + f AS m1, 12 * c + 2 * o AS m2, 24 * c AS m3,
  {_LABEL.format(_TERM.format(n="least(h, f)", d=1) + ", " + _TERM.format(n="greatest(h, f)", d=1))} AS label, {_LABEL.format(_TERM.format(n="(h + f)", d=1))} AS pure FROM c WHERE (h + f) % 2 = 0),
g AS (SELECT label, count(*) AS n FROM l GROUP BY 1), e AS (SELECT label, n::DOUBLE AS n FROM g WHERE n >= 40),
p AS (SELECT label, floor(exp(1.22066271 * n / 5 - 0.72953204)) AS n FROM g WHERE n BETWEEN 3 AND 39 AND n % 2 = 1),
j AS (SELECT l.*, e.n AS exact, p.n AS path, coalesce(q.n, d.n) AS base, 1 + (lgamma(t + 1) - lgamma(h + 1) - lgamma(f + 1)) / m1 AS scale,
  lgamma(m1 + 1) - lgamma(m1 // 2 + 1) - (m1 // 2) * ln(2) - c * ln(24) - o * ln(2) - m2 / (2 * m1) + pow(m2, 2) / (4 * pow(m1, 2)) + pow(m2, 4) / (4 * pow(m1, 5)) - pow(m2, 2) * m3 / (2 * pow(m1, 4)) + pow(m3, 2) / (6 * pow(m1, 3)) AS lg
  FROM l LEFT JOIN e USING (label) LEFT JOIN p USING (label) LEFT JOIN e d ON d.label = pure LEFT JOIN p q ON q.label = pure),
k AS (SELECT *, floor(floor(exp(1.22066271 * (0.75617982 * lg - 14.40107699) - 0.72953204)) / gamma(t + 1)) AS top FROM j),
v AS (SELECT CASE WHEN exact IS NOT NULL THEN 'exact' WHEN path IS NOT NULL THEN 'path' WHEN base > 0 THEN 'pure' WHEN c + o + t >= 20 THEN 'asymptotic' ELSE 'missing' END AS source,
  CASE WHEN exact IS NOT NULL THEN exact WHEN path IS NOT NULL THEN path WHEN base > 0 THEN floor(exp((greatest(ln(base), 1) + 0.72953204) * scale - 0.72953204))
  WHEN c + o + t >= 20 THEN CASE WHEN label = pure THEN top ELSE floor(exp((greatest(ln(greatest(top, 1)), 1) + 0.72953204) * scale - 0.72953204)) END END AS n FROM k)
SELECT source, count(*) AS cases, round(ln(1 + sum(n)), 6) AS ln_total FROM v GROUP BY 1""")
def _fallback(spark, folder):
    cases = cut(_mixed(spark, folder).withColumn("label", space.label_of(F.col("stoichiometry"))))
    labels = cases.groupBy("label").agg(F.count("*").alias("n"))
    paths = labels.where("n BETWEEN 3 AND 39 AND n % 2 = 1").select("label", (F.col("n") / 5.0).alias("length"))
    counted = space.count_cases(cases.drop("label"), labels.where("n >= 40"), paths)
    return counted.groupBy("source").agg(F.count("*").alias("cases"), F.round(F.ln(1 + F.sum("n")), 6).alias("ln_total"))


@register("missing_labels", _COUNTS + _KNOWN + " SELECT DISTINCT label FROM l WHERE t <= 20 AND label NOT IN (SELECT label FROM g WHERE n >= 40)")
def _missing(spark, folder):
    cases, known = _tables(spark, folder)
    return space.missing_labels(cases, known)


@register("stoichiometry_projections", _COUNTS + """ SELECT l_orderkey, CASE WHEN a > 0 THEN 4 WHEN r > 0 THEN 2 ELSE 1 END AS largest, repeat('H', n::INTEGER) || repeat('O', r::INTEGER) || repeat('C', a::INTEGER) AS elements,
 (a > 0)::INTEGER + (r > 0)::INTEGER + (n > 0)::INTEGER AS types FROM c""")
def _projections(spark, folder):
    s = F.col("stoichiometry")
    return _compositions(spark, folder).select("l_orderkey", space.largest_valence(s).alias("largest"), F.array_join(space.element_sequence(s), "").alias("elements"), F.size(F.map_keys(space.types_per_valence(s))).alias("types"))


@register("label_sets", _COUNTS + _KNOWN + """, f AS (SELECT label, t FROM l) SELECT 'both' AS part, count(*) AS n FROM (SELECT label FROM f WHERE t % 2 = 0 INTERSECT SELECT g.label FROM g WHERE n >= 40)
UNION ALL SELECT 'only', count(*) FROM (SELECT DISTINCT label FROM f WHERE t % 2 = 0) x WHERE label NOT IN (SELECT label FROM g WHERE n >= 40)""")
def _label_sets(spark, folder):
    cases, known = _tables(spark, folder)
    atoms = F.aggregate("stoichiometry", F.lit(0), lambda a, x: a + x["count"])
    even = cases.where(atoms % 2 == 0).select(space.label_of(F.col("stoichiometry")).alias("label")).distinct()
    count = lambda df, part: df.agg(F.lit(part).alias("part"), F.count("*").alias("n")).select("part", "n")
    return count(space.shared_labels(even, known), "both").unionByName(count(space.only_in(even, known), "only"))


# --- files that are written and read again ------------------------------------------------------------------------


@register("counts_round_trip", _COUNTS + _KNOWN + " SELECT label, CASE WHEN n >= 40 THEN n ELSE -1 END AS n, CASE WHEN n < 40 THEN round(n / 8, 6) ELSE -1 END AS length FROM g")
def _counts_files(spark, folder):
    rows = _compositions(spark, folder).groupBy(space.label_of(F.col("stoichiometry")).alias("label")).agg(F.count("*").alias("c"))
    at = scratch(spark)
    files.write_counts(rows.select("label", F.when(F.col("c") >= 40, F.col("c")).alias("n"), F.when(F.col("c") < 40, F.col("c") / 8.0).alias("length")), at)
    return files.read_counts(spark, at).select("label", F.coalesce(F.col("n").cast("long"), F.lit(-1)).alias("n"), F.coalesce(F.round("length", 6), F.lit(-1.0)).alias("length"))


@register("molecules_round_trip", "WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 HAVING count(*) >= 2) SELECT o_orderkey, round(o_totalprice / n, 6) AS label FROM orders JOIN c ON o_orderkey = l_orderkey")
def _molecule_files(spark, folder):
    at = scratch(spark)
    files.write_predictions(_xyz(spark, folder), at, compress=True)
    out = molecules.checked_selection(files.read_molecules(spark, at, "o_orderkey long, o_totalprice double, xyz string"), "n_C >= 2", "o_totalprice / n_C")
    return _rounded(out.select("o_orderkey", "label"), 6, "label")


@register("predictions_round_trip", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN round(c_acctbal / 3, 6) END AS charge FROM customer")
def _prediction_files(spark, folder):
    rows = _t(spark, folder, "customer").select("c_custkey", "c_acctbal")
    nan = F.lit(float("nan"))
    out = files.with_predictions(rows, rows.select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") / 3).otherwise(nan).alias("prediction")), "c_custkey", "charge")
    at = scratch(spark)
    files.write_predictions(out, at)
    return spark.read.schema("c_custkey long, charge double").json(at).select("c_custkey", F.round("charge", 6).alias("charge"))


@register("frequencies_round_trip", _COUNTS + f" SELECT {_HILL} AS SF, count(*) AS freq FROM c GROUP BY 1")
def _frequency_files(spark, folder):
    at = scratch(spark)
    files.write_csv(_compositions(spark, folder).groupBy(formulas.sum_formula(F.col("stoichiometry")).alias("SF")).agg(F.count("*").alias("freq")), at)
    return files.read_frequencies(spark, at)


@register("graph_lines", "WITH b AS (SELECT l_orderkey AS g, l_linenumber AS u, l_linenumber + 1 + l_suppkey % 2 AS v, l_suppkey % 3 + 1 AS bond FROM lineitem) SELECT u::INTEGER AS u, v::INTEGER AS v, bond::INTEGER AS bond, count(*) AS n FROM b GROUP BY 1, 2, 3")
def _graph_files(spark, folder):
    sign = F.element_at(F.array(F.lit("-"), F.lit("="), F.lit("#")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    bond = F.concat(F.col("l_linenumber").cast("string"), sign, (F.col("l_linenumber") + 1 + F.col("l_suppkey") % 2).cast("string"))
    lines = _t(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(" ", F.lit("1"), F.col("l_orderkey").cast("string"), F.lit("Aa9"), F.array_join(F.sort_array(F.collect_list(bond)), " ")).alias("value"))
    at = scratch(spark)
    lines.select("value").write.text(at)
    return files.read_graphs(spark, at).select(F.inline("bonds")).groupBy("u", "v", "bond").agg(F.count("*").alias("n"))


@register("formula_table", _COUNTS + f" SELECT {_HILL} AS formula, count(*)::DOUBLE AS n, count(*) AS cases FROM c GROUP BY 1")
def _formula_table(spark, folder):
    counted = _compositions(spark, folder).withColumns({"n": F.lit(1.0), "label": space.label_of(F.col("stoichiometry"))})
    # a group's list holds distinct stoichiometries only once they are counted
    once = counted.groupBy("stoichiometry", "label").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    return space.formula_table(once).join(once.groupBy(formulas.sum_formula(F.col("stoichiometry")).alias("formula")).agg(F.sum("c").alias("_c")), "formula").select("formula", "n", F.col("_c").alias("cases"))


# --- expansions, dimensions, graphs -------------------------------------------------------------------------------


@register("central_differences", "WITH p AS (SELECT p_brand, p_size, avg(p_retailprice) AS y FROM part GROUP BY 1, 2) SELECT p_brand, p_size, round((lead(y) OVER w - lag(y) OVER w) / 2, 4) AS first, round(lead(y) OVER w - 2 * y + lag(y) OVER w, 4) AS second FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def _differences(spark, folder):
    p = _t(spark, folder, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("y"))
    return _rounded(taylor.central_differences(p, ["p_brand"], "p_size", "y").drop("y"), 4, "first", "second")


@register("taylor_query", "WITH s AS (SELECT p_size AS x, avg(p_retailprice) AS y FROM part GROUP BY 1), c AS (SELECT max(y) FILTER (x = 24) AS a, max(y) FILTER (x = 25) AS b, max(y) FILTER (x = 26) AS c FROM s) SELECT p_partkey, round(b + (c - a) / 2 * (p_size - 25) + (c - 2 * b + a) / 2 * pow(p_size - 25, 2), 6) AS predicted FROM part, c")
def _taylor(spark, folder):
    part = _t(spark, folder, "part")
    table = part.groupBy(F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    near = cut(table.where(F.abs(F.col("x") - 25) <= 1))
    model = taylor.Taylor.fit(near, ["x"], ["y"], {"x": 25.0}, 2)
    return model.query(part.select("p_partkey", F.col("p_size").cast("double").alias("x")), ["y"]).select("p_partkey", F.round("pred_y", 6).alias("predicted"))


@register("taylor_detail", "WITH s AS (SELECT p_size AS x, avg(p_retailprice) AS y FROM part GROUP BY 1), c AS (SELECT max(y) FILTER (x = 24) AS a, max(y) FILTER (x = 25) AS b, max(y) FILTER (x = 26) AS c FROM s), t AS (SELECT unnest(['1', 'x', 'x^2']) AS term) SELECT term, round(sum(CASE term WHEN '1' THEN b WHEN 'x' THEN (c - a) / 2 * (p_size - 25) ELSE (c - 2 * b + a) / 2 * pow(p_size - 25, 2) END), 4) AS total FROM part, c, t GROUP BY 1")
def _taylor_detail(spark, folder):
    part = _t(spark, folder, "part")
    table = part.groupBy(F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    model = taylor.Taylor.fit(cut(table.where(F.abs(F.col("x") - 25) <= 1)), ["x"], ["y"], {"x": 25.0}, 2)
    return _rounded(model.detail(part.select(F.col("p_size").cast("double").alias("x")), "y").groupBy("term").agg(F.sum("value").alias("total")), 4, "total")


def _modes(spark, folder):
    return _t(spark, folder, "customer").select("c_nationkey", F.col("c_custkey").alias("mode"), (F.col("c_acctbal") / 1e7).alias("g"), ((F.col("c_custkey") % 97 + 1) / 1e3).alias("h"), ((F.col("c_custkey") % 89 - 44) / 1e4).alias("lam"))


_MODES = """WITH m AS (SELECT c_nationkey, c_custkey AS mode, c_acctbal / 1e7 AS g, (c_custkey % 97 + 1) / 1e3 AS h, (c_custkey % 89 - 44) / 1e4 AS lam FROM customer),
x AS (SELECT pow(10, k * (11.0::DOUBLE / 99) - 10) AS x FROM range(100) t(k)),
b AS (SELECT m.*, -coalesce((SELECT min(x) FROM x WHERE abs(-x * g + x * x * h / 2) > 4.75e-4), 10) AS low, coalesce((SELECT min(x) FROM x WHERE abs(x * g + x * x * h / 2) > 4.75e-4), 10) AS high FROM m)"""


@register("mode_bounds", _MODES + " SELECT mode, round(low, 8) AS low, round(high, 8) AS high FROM b")
def _bounds(spark, folder):
    return _rounded(dimension.bounds(_modes(spark, folder)).select("mode", "low", "high"), 8, "low", "high")


# the double sum over pairs of modes, as it is defined
@register("mode_error", _MODES + """, w AS (SELECT *, high - low AS w, pow(high, 3) - pow(low, 3) AS c, pow(high, 5) - pow(low, 5) AS f FROM b WHERE mode % 3 <> 0),
d AS (SELECT c_nationkey, sum(lam * lam / w * f / 5) AS v FROM w GROUP BY 1),
o AS (SELECT a.c_nationkey, sum(a.lam * b.lam / (a.w * b.w) * a.c * b.c / 9) AS v FROM w a JOIN w b ON a.c_nationkey = b.c_nationkey AND a.mode <> b.mode GROUP BY 1)
SELECT c_nationkey, round(sqrt(d.v + coalesce(o.v, 0)), 8) AS error FROM d LEFT JOIN o USING (c_nationkey)""")
def _mode_error(spark, folder):
    return _rounded(dimension.mode_error(dimension.bounds(_modes(spark, folder)).where("mode % 3 <> 0"), ["c_nationkey"]), 8, "error")


@register("best_by_dimension", "WITH b AS (SELECT l_suppkey, (l_linenumber * 2)::INTEGER AS dim, min(l_extendedprice) AS e FROM lineitem GROUP BY 1, 2), k AS (SELECT l_suppkey, d::INTEGER AS dim FROM (SELECT DISTINCT l_suppkey FROM lineitem), range(17) t(d)) SELECT l_suppkey, dim, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY l_suppkey ORDER BY dim), 0) AS error FROM k LEFT JOIN b USING (l_suppkey, dim)")
def _filled(spark, folder):
    tried = _t(spark, folder, "lineitem").select("l_suppkey", (F.col("l_linenumber") * 2).cast("int").alias("dim"), F.col("l_extendedprice").alias("error"))
    return dimension.best_by_dimension(tried, ["l_suppkey"], 16)


@register("greedy_dimensions")
def _greedy(spark, folder):
    e = _vectors(spark, folder)
    row = lambda at, k: F.transform(F.slice("v", at + 4 * k, 4), lambda x, j: (x + F.get("v", j * 4 + at - 1 + k)) / 20)
    square = lambda at: F.array(*(row(at, k) for k in range(4)))
    line = lambda at: F.transform(F.slice("v", at, 4), lambda x: x / 100)
    return dimension.intrinsic_dimension(e.select(F.col("id").alias("mol"), line(1).alias("g_e"), square(5).alias("h_e"), line(21).alias("g_p"), square(25).alias("h_p")))


_EDGES = "WITH e AS (SELECT l_suppkey AS g, l_linenumber AS u, (l_quantity % 7)::INTEGER + 10 AS v FROM lineitem), b AS (SELECT g, u, v, count(*) AS bond FROM e GROUP BY ALL)"


def _edges(spark, folder):
    return _t(spark, folder, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("u"), ((F.col("l_quantity") % 7).cast("int") + 10).alias("v"))


@register("bond_orders", _EDGES + " SELECT * FROM b")
def _bonds(spark, folder):
    return graphs.bond_orders(_edges(spark, folder))


@register("count_bonds", _EDGES + " SELECT g, count(*) AS n FROM b WHERE bond = 12 AND u % 2 = 0 AND v % 2 = 1 GROUP BY 1")
def _count_bonds(spark, folder):
    e = cut(_edges(spark, folder))
    nodes = e.select("g", F.explode(F.array("u", "v")).alias("node")).distinct()
    element = F.when(F.col("node") < 10, F.when(F.col("node") % 2 == 0, "C").otherwise("N")).otherwise(F.when(F.col("node") % 2 == 1, "H").otherwise("O"))
    return graphs.count_bonds(e, nodes.withColumn("element", element), "C", "H", 12)


@register("node_degrees", _EDGES + " SELECT g, node, count(*) AS degree FROM (SELECT g, u AS node FROM e UNION ALL SELECT g, v FROM e) GROUP BY 1, 2")
def _degrees(spark, folder):
    return graphs.degrees(_edges(spark, folder))


def _small_graphs(spark, folder):
    """Orders as graphs of few nodes: their edges, all nodes by element, and a node without bonds in every third."""
    edges = _t(spark, folder, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_linenumber") % 4).alias("u"), ((F.col("l_quantity") % 3).cast("int") + 10).alias("v"))
    ends = edges.select("g", F.explode(F.array("u", "v")).alias("node"))
    alone = _t(spark, folder, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("g"), F.lit(99).alias("node"))
    nodes = ends.unionByName(alone).distinct()
    return edges, nodes.withColumn("element", F.when(F.col("node") % 2 == 0, "C").otherwise("N"))


def _rounds(first: str, step: str, n: int) -> str:
    """SQL that applies a step n times: tables t0 ... tn."""
    return f"t0 AS ({first}), " + ", ".join(f"t{k + 1} AS ({step.format(t=f't{k}')})" for k in range(n))


_SMALL = """WITH e AS (SELECT l_orderkey AS g, l_linenumber % 4 AS u, (l_quantity % 3)::INTEGER + 10 AS v FROM lineitem),
b AS (SELECT g, u, v, count(*) AS bond FROM e GROUP BY ALL), near AS (SELECT g, u AS node, v AS other, bond FROM b UNION ALL SELECT g, v, u, bond FROM b),
n AS (SELECT DISTINCT g, node, CASE WHEN node % 2 = 0 THEN 'C' ELSE 'N' END AS el FROM (SELECT g, node FROM near UNION ALL SELECT o_orderkey, 99 FROM orders WHERE o_orderkey % 3 = 0)),
"""


@register("graph_classes", _SMALL + _rounds("SELECT g, node, el AS c FROM n", """SELECT a.g, a.node, md5(any_value(a.c) || ':' || coalesce(string_agg(w.bond || '.' || o.c, ',' ORDER BY w.bond, o.c), '')) AS c
  FROM {t} a LEFT JOIN near w USING (g, node) LEFT JOIN {t} o ON o.g = w.g AND o.node = w.other GROUP BY 1, 2""", 8) + """,
k AS (SELECT g, string_agg(c, ',' ORDER BY c) AS k FROM t8 GROUP BY 1) SELECT g, min(g) OVER (PARTITION BY k) AS class FROM k""")
def _graph_classes(spark, folder):
    return graphs.graph_classes(*_small_graphs(spark, folder))


@register("graph_pieces", _SMALL + _rounds("SELECT g, node, node AS l FROM n", """SELECT a.g, a.node, least(any_value(a.l), coalesce(min(o.l), any_value(a.l))) AS l
  FROM {t} a LEFT JOIN near w USING (g, node) LEFT JOIN {t} o ON o.g = w.g AND o.node = w.other GROUP BY 1, 2""", 8) + """
SELECT g, count(DISTINCT l) AS pieces, count(DISTINCT l) = 1 AS connected FROM t8 GROUP BY 1""")
def _graph_pieces(spark, folder):
    return graphs.connected(*_small_graphs(spark, folder))


@register("random_graphs")
def _random_graphs(spark, folder):
    d = _compositions(spark, folder).select(F.col("l_orderkey").alias("g"), space.degree_sequence(F.col("stoichiometry")).alias("s")).where(formulas.feasible(F.col("s")))
    return graphs.random_graphs(d.select("g", formulas.degrees_of(F.col("s")).alias("degrees")))


_SIX = ", ".join(f"{x}{k} AS (SELECT unnest([{', '.join(map(str, own))}]) AS {x}{k})" for x, own in (("e", (0, 2, 4)), ("o", (1, 3, 5))) for k in own)


@register("edit_distances", f"""
WITH r AS (SELECT c_nationkey AS g, c_custkey % 6 AS u, round(c_acctbal)::BIGINT % 6 AS v FROM customer), b AS (SELECT g, least(u, v) AS u, greatest(u, v) AS v, count(*) AS n FROM r WHERE u <> v AND v >= 0 GROUP BY ALL),
{_SIX}, p AS (SELECT row_number() OVER () AS id, [e0, o1, e2, o3, e4, o5] AS p FROM e0, o1, e2, o3, e4, o5 WHERE e0 <> e2 AND e0 <> e4 AND e2 <> e4 AND o1 <> o3 AND o1 <> o5 AND o3 <> o5),
g AS (SELECT DISTINCT g FROM b), w AS (SELECT x.g AS a, y.g AS b, p.id, p.p, i.u, j.v FROM g x JOIN g y ON x.g < y.g, p, range(6) i(u), range(6) j(v) WHERE i.u < j.v),
d AS (SELECT w.a, w.b, id, sum(abs(coalesce(m.n, 0) - coalesce(q.n, 0))) AS d FROM w LEFT JOIN b m ON m.g = w.a AND m.u = w.u AND m.v = w.v
  LEFT JOIN b q ON q.g = w.b AND q.u = least(p[w.u + 1], p[w.v + 1]) AND q.v = greatest(p[w.u + 1], p[w.v + 1]) GROUP BY 1, 2, 3)
SELECT a::BIGINT AS a, b::BIGINT AS b, min(d)::INTEGER AS distance FROM d GROUP BY 1, 2""")
def _edit(spark, folder):
    rows = _t(spark, folder, "customer").select(F.col("c_nationkey").cast("long").alias("g"), (F.col("c_custkey") % 6).cast("int").alias("u"), (F.round("c_acctbal").cast("long") % 6).cast("int").alias("v"))
    bonds = cut(graphs.bond_orders(rows.where("u <> v AND v >= 0")).select("g", "u", "v", F.col("bond").cast("int").alias("bond")))
    nodes = bonds.select("g").distinct().withColumn("classes", F.array(*(F.lit(k % 2) for k in range(6))))
    ids = bonds.select("g").distinct()
    return graphs.path_lengths(bonds, nodes, ids.toDF("a").join(ids.toDF("b"), F.col("a") < F.col("b")))


def _labelled(spark, folder):
    return _t(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("double").alias("y"))


def _ladder(spark, folder):
    """Labelled rows in shuffled order: a ladder of training sizes ends at four fifths of them, or where a dense solve does; and the held-out ones."""
    rows = cut(sampling.numbered(_labelled(spark, folder), "id", "0"))
    most = min(regression.MOST, rows.count() * 4 // 5)
    return rows.where(F.col("position") <= most), rows.where(F.col("position") > most), most


# trained on four fifths of all rows, predicting all
@register("krr_predict", """
WITH RECURSIVE e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::DOUBLE AS y, row_number() OVER (ORDER BY md5(vec_id || ':0'), vec_id) AS i FROM embeddings),
t AS (SELECT * FROM e WHERE i <= (SELECT count(*) * 4 // 5 FROM e)),
kk AS (SELECT a.i, list(exp(-pow(list_distance(a.v, b.v) / 1.5, 2)) ORDER BY b.i) AS r FROM t a, t b GROUP BY 1),
""" + _CG.format(lam=0.05) + """,
g AS (SELECT e.id, list(exp(-pow(list_distance(e.v, t.v) / 1.5, 2)) ORDER BY t.i) AS k FROM e, t GROUP BY 1)
SELECT id, round(list_dot_product(k, alpha) - list_avg(k) * whole - columns + grand * whole + shift, 5) AS prediction FROM g, best""")
def _krr(spark, folder):
    rows = sampling.numbered(_labelled(spark, folder), "id", "0")
    train = rows.where(F.col("position") <= rows.count() * 4 // 5).select("id", "v", "y")
    return _rounded(ridge.predict_vectors(ridge.fit_vectors(train, "Gaussian", 1.5, 0.05), _labelled(spark, folder)), 5, "prediction")


# two training rows, the mean vectors of even and odd labels, have a closed solution
@register("krr_two_means", """
WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label::DOUBLE AS y, label % 2 AS s FROM embeddings),
u AS (SELECT s, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e), m AS (SELECT s, list(a ORDER BY i) AS v FROM (SELECT s, i, avg(x) AS a FROM u GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT s, avg(y) AS y FROM e GROUP BY 1), p AS (SELECT a.v AS a, b.v AS b, c.y AS ya, d.y AS yb FROM m a, m b, t c, t d WHERE a.s = 0 AND b.s = 1 AND c.s = 0 AND d.s = 1),
w AS (SELECT *, (ya - yb) / 2 / (1 - exp(-pow(list_distance(a, b) / 1.5, 2)) + 0.01) AS alpha FROM p)
SELECT id, round((ya + yb) / 2 + alpha * (exp(-pow(list_distance(v, a) / 1.5, 2)) - exp(-pow(list_distance(v, b) / 1.5, 2))), 6) AS prediction FROM e, w""")
def _two_means(spark, folder):
    rows = _labelled(spark, folder).withColumn("s", F.col("y").cast("long") % 2)
    each = rows.select("s", F.posexplode("v").alias("i", "x")).groupBy("s", "i").agg(F.avg("x").alias("a"))
    vectors = each.groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "a"))), lambda x: x["a"]).alias("v"))
    train = vectors.join(rows.groupBy("s").agg(F.avg("y").alias("y")), "s").withColumnRenamed("s", "id")
    return _rounded(regression.predict(train, rows, "Gaussian", 1.5, 0.01), 6, "prediction")


@register("krr_hyperparameters")
def _hyper(spark, folder):
    train, _, _ = _ladder(spark, folder)
    scale = pairs.length_scale(train.select("id", "v")).first()["scale"]
    return regression.hyperparameters(train, "Gaussian", [scale * f for f in regression.FACTORS])


@register("krr_learning_curve")
def _learning(spark, folder):
    train, held, most = _ladder(spark, folder)
    return regression.learning_curve(train, held, "Gaussian", sampling.training_sizes(min(128, most), most))


@register("detrend_blocks", """
WITH a AS (SELECT l_orderkey AS k, l_linenumber AS z, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, l_quantity / 10 AS x, l_discount AS y, l_tax AS zc FROM lineitem),
c AS (SELECT k, """ + ", ".join(f"count(*) FILTER (z = {z}) AS n_{z}" for z in range(1, 8)) + """ FROM a GROUP BY 1),
p AS (SELECT a.k, sum(pow(a.z * b.z, 2.5) * exp(-3 * sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.zc - b.zc, 2)))) AS f FROM a JOIN a b ON a.k = b.k AND a.i < b.i GROUP BY 1)
SELECT o_orderkey AS k, """ + ", ".join(f"coalesce(n_{z}, 0) AS n_{z}" for z in range(1, 8)) + """, round(coalesce(f, 0), 4) AS pairs, """ + ", ".join(f"(o_custkey % 3 = {q})::INTEGER AS charge_{q}" for q in range(3)) + """ FROM orders LEFT JOIN c ON o_orderkey = c.k LEFT JOIN p ON o_orderkey = p.k""")
def _blocks(spark, folder):
    atoms = _atoms(spark, folder).withColumnsRenamed({"l_orderkey": "k", "idx": "i"})
    rows = _t(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 3).alias("charge"))
    out, names = regression.detrend_design(rows, "k", ["charge", "pairs", "atomic"], atoms)
    return _rounded(out.select("k", *names), 4, "pairs")
