"""Histogram gradient boosting for counts, with a Poisson loss.

Features are cut into bins once. Each level of a tree is one aggregate, the sums of gradients and curvatures by (node,
feature, bin), from which the driver reads the best splits: nodes x features x bins rows, whatever the table
holds. Sums are of whole numbers, so that the model does not depend on how the rows are dealt out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.sources.staging import stage

FINE = 4096  # equal bins in which values are counted before edges are chosen
UNIT_SUM = 1 << 20  # steps of 1 in which gradients are added up
REWRITE = 10  # trees after which the scores are written, so that no plan holds more


@dataclass
class Params:
    trees: int = 30
    depth: int = 3
    bins: int = 32
    rate: float = 0.1
    l2: float = 1.0
    least: int = 5  # rows of a leaf
    gain: float = 1e-9


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Up to bins - 1 upper edges per feature, near its quantiles: two aggregates, FINE counts a feature at most."""
    x = lambda f: F.col(f).cast("double")
    ends = rows.agg(*[F.min(x(f)).alias(f"lo_{i}") for i, f in enumerate(features)], *[F.max(x(f)).alias(f"hi_{i}") for i, f in enumerate(features)]).first()
    spans = [(ends[f"lo_{i}"] or 0.0, ends[f"hi_{i}"] or 0.0) for i in range(len(features))]
    at = [F.least(F.floor((x(f) - lo) * (FINE / (hi - lo))), F.lit(FINE - 1)) if hi > lo else F.lit(0).cast("long") for f, (lo, hi) in zip(features, spans, strict=True)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), a.alias("b")) for i, a in enumerate(at)])).alias("x")
    counts: dict[int, list[tuple[int, int]]] = {}
    for f, b, n in rows.select(each).groupBy("x.f", "x.b").count().collect():
        counts.setdefault(f, []).append((b, n))
    out = {}
    for i, f in enumerate(features):
        (lo, hi), total, seen, edges = spans[i], sum(n for _, n in counts.get(i, [])), 0, []
        for b, n in sorted(counts.get(i, []))[:-1]:
            if (seen + n) * bins // total > seen * bins // total:
                edges.append(lo + (b + 1) * ((hi - lo) / FINE))
            seen += n
        out[f] = edges
    return out


@dataclass
class Split:
    feature: str
    edge: float
    at: int  # bins up to this one go left
    left: Split | float
    right: Split | float


def _value(node: Split | float, test) -> Column:
    return F.lit(float(node)) if not isinstance(node, Split) else F.when(test(node), _value(node.left, test)).otherwise(_value(node.right, test))


@dataclass
class Model:
    """Log mean = start + sum of trees."""

    start: float
    trees: list[Split | float]

    def predict(self, rows: DataFrame, name: str) -> DataFrame:
        """rows with the expected count. A missing feature goes right, as a large value does."""
        on = lambda s: F.coalesce(F.col(s.feature).cast("double") <= s.edge, F.lit(False))
        score = reduce(lambda a, t: a + _value(t, on), self.trees, F.lit(self.start))
        return rows.withColumn(name, F.exp(score))


def fit(rows: DataFrame, features: list[str], label: str, weight: str | None = None, params: Params | None = None) -> Model:
    """A model of a label of counts, not below 0. An empty table, or one without any count, gives a mean of nearly 0."""
    p = params or Params()
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    total = rows.agg(F.sum(w * F.col(label)), F.sum(w)).first()
    start = math.log(max((total[0] or 0.0) / (total[1] or 1.0), 1e-6))
    edges = bin_edges(rows, features, p.bins)
    place = lambda f: reduce(lambda a, e: a + F.coalesce(F.col(f).cast("double") > e, F.lit(True)).cast("tinyint"), edges[f], F.lit(0).cast("tinyint"))
    data = stage(rows.select(*[place(f).alias(f"b{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"), w.alias("w"), F.lit(start).alias("score")), "boosting")
    trees: list[Split | float] = []
    new: list[Split | float] = []
    number = {f: i for i, f in enumerate(features)}
    binned = lambda s: F.col(f"b{number[s.feature]}") <= s.at
    for k in range(p.trees):
        score = reduce(lambda a, t: a + _value(t, binned), new, F.col("score"))
        if len(new) == REWRITE:
            data, new = stage(data.withColumn("score", score), "boosting"), []
            score = F.col("score")
        whole = lambda c: F.round(c * UNIT_SUM).cast("decimal(20,0)")
        graded = data.withColumn("m", F.col("w") * F.exp(score)).select(*[f"b{i}" for i in range(len(features))], whole(F.col("m") - F.col("w") * F.col("y")).alias("g"), whole(F.col("m")).alias("h"))
        tree = _grow(graded, features, edges, p)
        trees.append(tree)
        new.append(tree)
        if not isinstance(tree, Split) and k and not isinstance(trees[-2], Split):
            break  # nothing left to split
    return Model(start, trees)


def _grow(graded: DataFrame, features: list[str], edges: dict[str, list[float]], p: Params) -> Split | float:
    """One tree, level by level. Nodes are numbered as in a heap, from 1."""
    splits: dict[int, tuple[int, int]] = {}
    sums: dict[int, tuple[float, float]] = {}
    node, open_nodes = F.lit(1), [1]
    for level in range(p.depth):
        each = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b{i}").cast("int").alias("b")) for i in range(len(features))])
        found = graded.withColumn("node", node).filter(F.col("node").isin(open_nodes)).select("node", "g", "h", F.explode(each).alias("x"))
        found = found.groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()
        hist: dict[int, dict[int, dict[int, tuple]]] = {}
        for r in found:
            hist.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (int(r["g"]) / UNIT_SUM, int(r["h"]) / UNIT_SUM, r["n"])
        below = []
        for at in open_nodes:
            best = best_split(hist.get(at, {}), p)
            if at == 1:
                first = hist.get(1, {}).get(0, {}).values()
                sums[1] = (sum(v[0] for v in first), sum(v[1] for v in first))
            if best:
                _, f, b, left, right = best
                splits[at], sums[2 * at], sums[2 * at + 1] = (f, b), left, right
                below += [2 * at, 2 * at + 1]
        step = reduce(lambda a, k: a.when((node == k) & (F.col(f"b{splits[k][0]}") <= splits[k][1]), 2 * k).when(node == k, 2 * k + 1), [k for k in open_nodes if k in splits], F.when(F.lit(False), F.lit(0)))
        node, open_nodes = F.coalesce(step, node), below
        if not below:
            break

    def made(at: int) -> Split | float:
        if at in splits:
            f, b = splits[at]
            return Split(features[f], edges[features[f]][b], b, made(2 * at), made(2 * at + 1))
        g, h = sums.get(at, (0.0, 0.0))
        return -p.rate * g / (h + p.l2) if h + p.l2 > 0 else 0.0

    return made(1)


def best_split(hist: dict[int, dict[int, tuple]], p: Params) -> tuple | None:
    """(gain, feature, last bin on the left, sums left, sums right) of the largest gain; ties go to the first feature and
    bin. hist: feature: bin: (gradient, curvature, rows)."""
    best = None
    fits = lambda g, h: g * g / (h + p.l2)
    for f in sorted(hist):
        bins = sorted(hist[f].items())
        g, h, n = (sum(v[i] for _, v in bins) for i in range(3))
        gl = hl = nl = 0
        for b, v in bins[:-1]:
            gl, hl, nl = gl + v[0], hl + v[1], nl + v[2]
            if min(nl, n - nl) < p.least:
                continue
            gain = fits(gl, hl) + fits(g - gl, h - hl) - fits(g, h)
            if gain > p.gain and (best is None or gain > best[0] + 1e-12):
                best = (gain, f, b, (gl, hl), (g - gl, h - hl))
    return best
