"""Multivariate Taylor expansions fitted to stencils of points, and finite differences."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(variables: list[str], order: int) -> list[tuple[str, ...]]:
    """All products of variables up to an order, the constant not included."""
    return [t for n in range(1, order + 1) for t in itertools.combinations_with_replacement(variables, n)]


def stencil(points: DataFrame, variables: list[str], center: dict[str, float], most: int, nearest: int) -> DataFrame:
    """The points that a term of ``most`` variables may use: those that differ from the center in at most that many
    coordinates, and of every orthant the ``nearest`` ones; the center itself is in."""
    moved = [F.col(v) - F.lit(float(center[v])) for v in variables]
    changed = sum(((m != 0).cast("int") for m in moved), F.lit(0))
    orthant = F.concat(*((F.signum(m).cast("int").cast("string")) for m in moved))
    distance = sum((m * m for m in moved), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("_o").orderBy("_d", *variables))
    return points.where(changed <= most).withColumn("_o", orthant).withColumn("_d", distance).withColumn("_r", rank).where(F.col("_r") <= nearest).drop("_o", "_d", "_r")


def _weights(offsets: np.ndarray, powers: tuple[int, ...], order: int) -> np.ndarray:
    """Weights of values at offsets that give the mixed derivative: sums of weighted monomials match it up to an order."""
    scale = np.abs(offsets).max() or 1.0
    scaled = offsets / scale
    rows = [p for p in itertools.product(range(order + 1), repeat=offsets.shape[1]) if sum(p) <= order]
    a = np.array([np.prod(scaled ** np.array(p), axis=1) for p in rows])
    b = np.array([math.prod(map(math.factorial, p)) if p == powers else 0.0 for p in rows])
    w, *_ = np.linalg.lstsq(a, b, rcond=1e-12)
    if np.abs(a @ w - b).max() > 1e-6 * max(1.0, b.max()):
        raise ValueError(f"the stencil cannot resolve the derivative {powers}")
    return w / scale ** sum(powers)


#: Points of a candidate stencil at most, the nearest ones, and those of each orthant beyond the order in the smallest.
NEAREST, EXTRA = 256, 3


def candidate_stencils(points: DataFrame, variables: list[str], center: dict[str, float], wanted: list[tuple[str, ...]]) -> DataFrame:
    """The points that each term may be fitted to, by four rules, a row each: ``term, rule, offsets``, and the points' columns.

    0: in every orthant of the term's own variables, the others centred, the nearest few, and the planes of the term without
    one of its repeated variables; 1: points that differ in no more variables than the term's order, one of them its own;
    2: in any of its own; 3: all. The center is always in. Of a rule's points the NEAREST are kept, by ranks that
    Spark limits before its shuffle, so a term's rows are few whatever the table.
    """
    spark = points.sparkSession
    powers = [([t.count(v) for v in variables], k) for k, t in enumerate(wanted)]
    table = F.broadcast(spark.createDataFrame(powers, "_w array<int>, term int"))
    offsets = F.array(*((F.col(v) - F.lit(float(center[v]))).cast("double") for v in variables))
    rows = points.withColumn("offsets", offsets).crossJoin(table)
    moved = F.zip_with("offsets", "_w", lambda x, w: F.struct((x != 0).alias("m"), (w > 0).alias("own"), x.alias("x"), w.alias("w")))
    rows = rows.withColumn("_p", moved).withColumn("_d", F.aggregate("offsets", F.lit(0.0), lambda a, x: a + x * x))
    at_center, order = F.col("_d") == 0, F.aggregate("_w", F.lit(0), lambda a, w: a + w)
    others_rest = F.forall("_p", lambda p: p["own"] | ~p["m"])
    changed, any_own = F.size(F.filter("_p", lambda p: p["m"])), F.exists("_p", lambda p: p["own"] & p["m"])
    # a repeated variable rests, and so do all others but the term's own
    plane = F.exists("_p", lambda p: p["own"] & (p["w"] > 1) & ~p["m"]) & others_rest & (F.size(F.filter("_p", lambda p: p["own"] & (p["w"] > 1) & ~p["m"])) > 0)
    orthant = F.array_join(F.transform(F.filter("_p", lambda p: p["own"]), lambda p: F.when(p["x"] > 0, "+").otherwise("-")), "")
    nearest = lambda *by: F.row_number().over(Window.partitionBy("term", *by).orderBy("_d", *variables))
    first = rows.where(others_rest & ~at_center).withColumn("_o", orthant).withColumn("_n", nearest("_o"))
    first = first.where(F.col("_n") <= order + EXTRA).drop("_o", "_n")
    first = first.unionByName(rows.where(plane & ~at_center)).unionByName(rows.where(at_center)).dropDuplicates(["term", *variables])
    rules = [first, rows.where(at_center | (any_own & (changed <= order))), rows.where(at_center | any_own), rows]
    out = None
    for k, rule in enumerate(rules):
        part = rule.drop("_p", "_w").withColumn("rule", F.lit(k)).withColumn("_n", nearest()).where(F.col("_n") <= NEAREST).drop("_n", "_d")
        out = part if out is None else out.unionByName(part)
    return out


class Taylor:
    """An expansion of outputs around a center: ``monomials`` are (output, powers, derivative)."""

    def __init__(self, variables: list[str], center: dict[str, float], monomials: list[tuple[str, dict[str, int], float]]):
        self.variables, self.center, self.monomials = variables, center, monomials

    @staticmethod
    def fit(points: DataFrame, variables: list[str], outputs: list[str], center: dict[str, float], order: int) -> Taylor:
        """Fits all terms up to an order. A stencil is small, as only the nearest points of each orthant are used.

        Errors: no or several points at the center, repeated points, a stencil that cannot resolve a term.
        """
        at = points.where(" AND ".join(f"`{v}` = {float(center[v])!r}D" for v in variables)).limit(2).collect()
        if len(at) != 1:
            raise ValueError(f"{len(at)} points at the center")
        if not points.groupBy(*variables).count().where("count > 1").isEmpty():
            raise ValueError("points repeat")
        out = [(o, {}, float(at[0][o])) for o in outputs]
        for term in terms(variables, order):
            own = sorted(set(term), key=variables.index)
            rest = [v for v in variables if v not in own]
            plane = points.where(" AND ".join(f"`{v}` = {float(center[v])!r}D" for v in rest)) if rest else points
            rows = stencil(plane, own, center, len(own), order + 3).collect()
            offsets = np.array([[r[v] - center[v] for v in own] for r in rows])
            w = _weights(offsets, tuple(term.count(v) for v in own), order)
            for o in outputs:
                out.append((o, {v: term.count(v) for v in own}, float(w @ np.array([r[o] for r in rows]))))
        return Taylor(variables, center, out)

    @staticmethod
    def search(points: DataFrame, variables: list[str], outputs: list[str], center: dict[str, float], order: int, additional: list[tuple[str, ...]] = ()) -> Taylor:
        """Fits all terms up to an order, and ``additional`` ones, each to the best of its candidate stencils.

        The moment equations of every term and candidate are solved side by side; of those that resolve the term the one
        with the fewest points is taken, then the first rule. Errors: as of fit(), an unknown variable in a term, fewer
        points than terms.
        """
        if unknown := {v for t in additional for v in t} - set(variables):
            raise ValueError(f"no such variables: {sorted(unknown)}")
        wanted = [*terms(variables, order), *additional]
        at = points.where(" AND ".join(f"`{v}` = {float(center[v])!r}D" for v in variables)).limit(2).collect()
        if len(at) != 1:
            raise ValueError(f"{len(at)} points at the center")
        if not points.groupBy(*variables).count().where("count > 1").isEmpty():
            raise ValueError("points repeat")
        if len(wanted) > (given := points.count()):
            raise ValueError(f"{len(wanted)} terms need as many points, {given} are given")
        powers = [tuple(t.count(v) for v in variables) for t in wanted]

        def solve(rows):
            k, rule = int(rows["term"].iloc[0]), int(rows["rule"].iloc[0])
            offsets = np.array(rows["offsets"].tolist(), float)
            used = np.flatnonzero((offsets != 0).any(0))
            none = rows.iloc[:0][[]].assign(term=[], rule=[], n=[], **{f"d{j}": [] for j in range(len(outputs))})
            if any(p and j not in used for j, p in enumerate(powers[k])):
                return none
            try:
                w = _weights(offsets[:, used], tuple(powers[k][j] for j in used), sum(powers[k]))
            except (ValueError, np.linalg.LinAlgError):
                return none
            n = int((np.abs(w) > 1e-12 * np.abs(w).max()).sum())
            return rows.iloc[:1][["term", "rule"]].assign(n=n, **{f"d{j}": float(w @ rows[o].to_numpy(float)) for j, o in enumerate(outputs)})

        made = ", ".join(f"d{j} double" for j in range(len(outputs)))
        solved = candidate_stencils(points.select(*variables, *outputs), variables, center, wanted).groupBy("term", "rule").applyInPandas(solve, f"term int, rule int, n int, {made}")
        best = {r["term"]: r["b"] for r in solved.groupBy("term").agg(F.min(F.struct("n", "rule", *(f"d{j}" for j in range(len(outputs))))).alias("b")).collect()}
        out = [(o, {}, float(at[0][o])) for o in outputs]
        for k, term in enumerate(wanted):
            if k not in best:
                raise ValueError(f"no stencil resolves {term}")
            own = sorted(set(term), key=variables.index)
            out += [(o, {v: term.count(v) for v in own}, best[k][f"d{j}"]) for j, o in enumerate(outputs)]
        return Taylor(variables, center, out)

    def column(self, output: str) -> Column:
        """The expansion as one native expression of the variables' columns."""
        total = F.lit(0.0)
        for o, powers, value in self.monomials:
            if o == output:
                part = F.lit(value / math.prod(math.factorial(p) for p in powers.values()))
                for v, p in powers.items():
                    part = part * F.pow(F.col(v) - F.lit(float(self.center[v])), float(p))
                total = total + part
        return total

    def query(self, points: DataFrame, outputs: list[str]) -> DataFrame:
        """Adds ``pred_<output>`` to a table of points."""
        return points.select("*", *(self.column(o).alias(f"pred_{o}") for o in outputs))

    def detail(self, points: DataFrame, output: str) -> DataFrame:
        """What each term adds at each point: the points' columns, ``term`` (variables with their powers) and ``value``."""
        parts = []
        for o, powers, derivative in self.monomials:
            if o == output:
                value = F.lit(derivative / math.prod(math.factorial(p) for p in powers.values()))
                for v, p in powers.items():
                    value = value * F.pow(F.col(v) - F.lit(float(self.center[v])), float(p))
                name = " ".join(v if p == 1 else f"{v}^{p}" for v, p in powers.items()) or "1"
                parts.append(F.struct(F.lit(name).alias("term"), value.alias("value")))
        return points.select("*", F.inline(F.array(*parts)))

    def gradient_and_hessian(self, output: str) -> tuple[float, np.ndarray, np.ndarray]:
        """Constant, gradient and Hessian in the order of the variables."""
        n = len(self.variables)
        constant, g, h = 0.0, np.zeros(n), np.zeros((n, n))
        for o, powers, value in self.monomials:
            if o == output:
                at = [self.variables.index(v) for v, p in powers.items() for _ in range(p)]
                if not at:
                    constant = value
                elif len(at) == 1:
                    g[at[0]] = value
                elif len(at) == 2:
                    h[at[0], at[1]] = h[at[1], at[0]] = value
        return constant, g, h

    def maximize(self, output: str, bounds: dict[str, tuple[float, float]], steps: int = 500) -> dict[str, float]:
        """A maximum within bounds."""
        turned = Taylor(self.variables, self.center, [(o, powers, -d) for o, powers, d in self.monomials])
        return turned.minimize(output, bounds, steps)

    def reach(self, output: str, target: float, bounds: dict[str, tuple[float, float]], steps: int = 500) -> dict[str, float]:
        """A point within bounds whose value comes closest to a target, by bisection between a minimum and a maximum."""
        ends = [np.array([x[v] for v in self.variables]) for x in (self.minimize(output, bounds, steps), self.maximize(output, bounds, steps))]
        low, high = 0.0, 1.0
        at = lambda t: dict(zip(self.variables, (ends[0] + t * (ends[1] - ends[0])).tolist(), strict=True))
        if not self.value(output, at(0.0)) < target < self.value(output, at(1.0)):
            return at(0.0) if target <= self.value(output, at(0.0)) else at(1.0)
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if self.value(output, at(middle)) < target else (low, middle)
        return at(high)

    def value(self, output: str, at: dict[str, float]) -> float:
        """The expansion at one point."""
        return sum(d * math.prod((at[v] - self.center[v]) ** p / math.factorial(p) for v, p in powers.items()) for o, powers, d in self.monomials if o == output)

    def minimize(self, output: str, bounds: dict[str, tuple[float, float]], steps: int = 500) -> dict[str, float]:
        """A minimum within bounds, by projected gradient steps with backtracking from the center."""
        low, high = (np.array([bounds[v][k] for v in self.variables]) for k in (0, 1))
        origin = np.array([self.center[v] for v in self.variables], float)

        def value(x):
            return self.value(output, dict(zip(self.variables, x.tolist(), strict=True)))

        x, size = np.clip(origin, low, high), 1.0
        for _ in range(steps):
            e = 1e-6 * np.maximum(1, np.abs(x))
            g = np.array([(value(x + e[k] * np.eye(len(x))[k]) - value(x - e[k] * np.eye(len(x))[k])) / (2 * e[k]) for k in range(len(x))])
            while size > 1e-12:
                y = np.clip(x - size * g, low, high)
                if value(y) < value(x):
                    break
                size /= 2
            if size <= 1e-12:
                break
            x, size = y, size * 2
        return dict(zip(self.variables, x.tolist(), strict=True))


def central_differences(table: DataFrame, key: list[str], index: str, value: str) -> DataFrame:
    """Adds ``first`` and ``second`` derivative by unit steps of an index within a key; null at the ends."""
    order = Window.partitionBy(*key).orderBy(index)
    before, after = F.lag(value).over(order), F.lead(value).over(order)
    return table.withColumns({"first": (after - before) / 2, "second": after - 2 * F.col(value) + before})
