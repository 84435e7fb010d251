"""Approximate nearest neighbours by learned partitions (after Neural LSH, Dong et al., 2020).

A bounded sample's nearest-neighbour graph is cut into balanced parts by recursive spectral
bisection with swaps; a small network learns where a vector's neighbours lie, as shares of the parts. It
gives every row of the table to its most probable part and routes each query to the most probable
ones until their shares reach a mass: few in clustered data, most of them where neighbours lie
scattered. The mass is the least that finds the wanted share of the neighbours of sampled vectors that
neither graph nor network has seen. There all rows are compared in double precision. The number of parts follows that of rows,
as far as the sample can tell parts apart; parts are dealt in blocks of bounded size for rows and
queries, so no group grows with the table.

The most frequent vector length is indexed so; vectors of any other length can only be compared with
their like and form one part for each length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.llm.common import save, ship_by_value, table

ship_by_value(__name__)


@dataclass
class Params:
    sample_rows: int = 4096  # bound on the vectors that the graph and the network are made from
    part_rows: int = 500  # rows of a part that the number of parts, a power of two, aims at
    least_sampled: int = 16  # sampled vectors of a part, which bounds the number of parts
    graph_k: int = 10
    held_rows: int = 1024  # bound on the further sampled vectors, which set the mass; a fifth of a small sample
    found: float = 0.97  # share of these vectors' neighbours that their parts hold
    block_rows: int = 20_000
    block_queries: int = 2_000
    hidden: int = 256
    steps: int = 60
    decay: float = 1e-3
    seed: int = 9


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of the symmetric nearest-neighbour graph by cosine."""
    k = min(k, len(x) - 1)
    if k < 1:
        return np.zeros(0, int), np.zeros(0, int)
    near = []
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -2
        near.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    a, b = np.repeat(np.arange(len(x)), k), np.concatenate(near).ravel()
    return np.concatenate([a, b]), np.concatenate([b, a])


def _halve(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A side (0 or 1) for each node, equal in number, that cuts few of the edges."""
    n = len(x)
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    centred = x - x.mean(axis=0)
    w = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
    for _ in range(60):  # smooth along the edges: towards the second eigenvector
        w = (w + np.bincount(a, w[b], n) / degree) / 2
        w -= (w * degree).sum() / degree.sum()
        w /= max(np.abs(w).max(), 1e-300)
    side = np.zeros(n, int)
    side[np.argsort(w, kind="stable")[n // 2 :]] = 1
    best, best_cut = side.copy(), np.inf
    for _ in range(20):  # swap the pairs that gain most
        cut = int((side[a] != side[b]).sum())
        if cut >= best_cut:
            break
        best, best_cut = side.copy(), cut
        gain = np.bincount(a, np.where(side[a] != side[b], 1, -1), n)
        order = [s[np.argsort(-gain[s], kind="stable")] for s in (np.flatnonzero(side == 0), np.flatnonzero(side == 1))]
        pairs = min(map(len, order))
        both = gain[order[0][:pairs]] + gain[order[1][:pairs]]
        m = min(int((both > 0).sum()), max(n // 20, 1))
        side[order[0][:m]], side[order[1][:m]] = 1, 0
    return best


def balanced_parts(x: np.ndarray, levels: int, k: int) -> np.ndarray:
    """A part below 2 ** levels for each unit vector; parts differ by a node per level at most."""
    a, b = _graph(x, k)
    part = np.zeros(len(x), int)
    for _ in range(levels):
        new = part * 2
        for p in range(part.max() + 1):
            nodes = np.flatnonzero(part == p)
            if len(nodes) < 2:
                continue
            at = np.full(len(x), -1)
            at[nodes] = np.arange(len(nodes))
            inside = (at[a] >= 0) & (at[b] >= 0)
            new[nodes] += _halve(x[nodes], at[a[inside]], at[b[inside]])
        part = new
    return part


def shares(x: np.ndarray, part: np.ndarray, k: int) -> np.ndarray:
    """For each node of the graph the share of its neighbours in each part."""
    a, b = _graph(x, k)
    out = np.zeros((len(x), int(part.max()) + 1))
    np.add.at(out, (a, part[b]), 1)
    return out / out.sum(axis=1, keepdims=True)


def train(x: np.ndarray, target: np.ndarray, params: Params) -> list[np.ndarray]:
    """Weights of a network with one hidden layer that gives a unit vector's shares, by Adam."""
    rng = np.random.default_rng(params.seed)
    n, d = x.shape
    scaled = x * np.sqrt(d)
    net = [rng.normal(0, np.sqrt(2 / d), (d, params.hidden)), np.zeros(params.hidden), rng.normal(0, np.sqrt(1 / params.hidden), (params.hidden, target.shape[1])), np.zeros(target.shape[1])]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in net]
    for step in range(1, params.steps + 1):
        h = np.maximum(scaled @ net[0] + net[1], 0)
        off = (_softmax(h @ net[2] + net[3]) - target) / n
        back = (off @ net[2].T) * (h > 0)
        for i, g in enumerate((scaled.T @ back, back.sum(axis=0), h.T @ off, off.sum(axis=0))):
            first, second = moments[i]
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            # the decay stands beside the scaled step: dividing it by a vanishing gradient would blow weights up
            net[i] = net[i] * (1 - 0.01 * params.decay) - 0.01 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return net


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _shares_of(x: np.ndarray, net: list[np.ndarray]) -> np.ndarray:
    return _softmax(np.maximum(x * np.sqrt(x.shape[1]) @ net[0] + net[1], 0) @ net[2] + net[3])


def _probable(x: np.ndarray, net: list[np.ndarray], mass: float) -> list[np.ndarray]:
    """Parts of each vector, most probable first, until their shares reach mass."""
    p = _shares_of(_unit(x), net)
    order = np.argsort(-p, axis=1, kind="stable").astype(np.int32)
    count = np.minimum((np.cumsum(np.take_along_axis(p, order, 1), axis=1) < mass).sum(axis=1) + 1, p.shape[1])
    return [o[:n] for o, n in zip(order, count, strict=True)]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision times powers of two, so that squares of no finite vector overflow or vanish; cosines stay the same to the last bit."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return _scaled(flat.reshape(len(column), -1))


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v) of the rows that take part: an id, and a vector without nulls or non-finite
    components that is not all zero. Written once, so that the row numbers hold."""
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    v = F.col("embedding").cast("array<float>" if single else "array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.filter(~F.exists("v", bad) & F.exists("v", lambda c: c != 0))
    return save(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")


def fit(rows: DataFrame, params: Params) -> tuple[int, list[np.ndarray], float]:
    """The length of vectors that are indexed, the network that tells their parts, and the mass that queries are routed to."""
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.filter(F.size("v") == sizes["size"])
    sample = rows.orderBy(F.xxhash64(F.lit(params.seed), "vec_id", "v"), "vec_id").limit(params.sample_rows + params.held_rows).select("v").toArrow()
    x = _unit(_matrix(sample.column("v").combine_chunks()))
    held = x[: min(params.held_rows, len(x) // 5)]
    x = x[len(held) :]
    levels = max(int(np.log2(min(sizes["count"] / params.part_rows * 2, len(x) / params.least_sampled))), 0)
    if not levels or len(x) < 3:
        return sizes["size"], train(x, np.ones((len(x), 1)), params), 1.0
    net = train(x, shares(x, balanced_parts(x, levels, params.graph_k), params.graph_k), params)
    return sizes["size"], net, needed_mass(held, np.concatenate([held, x]), net, params)


def needed_mass(held: np.ndarray, x: np.ndarray, net: list[np.ndarray], params: Params) -> float:
    """The least mass at which the wanted share of the neighbours among x of held (its first rows) is found."""
    part, p = _shares_of(x, net).argmax(axis=1), _shares_of(held, net)
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.zeros_like(p)  # the shares of more probable parts
    np.put_along_axis(before, order, np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1), 1)
    s = held @ x.T
    s[np.arange(len(held)), np.arange(len(held))] = -2
    near = np.argpartition(-s, params.graph_k - 1, axis=1)[:, : params.graph_k]
    return float(np.quantile(np.take_along_axis(before, part[near], 1), params.found, method="higher")) + 1e-9


def routed(rows: DataFrame, size: int, net: list[np.ndarray], mass: float) -> DataFrame:
    """rows, each with the array of its most probable parts; those of another length get part -length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = _probable(_matrix(batch.column("v")), net, mass)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], ["row", "vec_id", "v", "parts"])

    schema = T.StructType([*rows.schema.fields, T.StructField("parts", T.ArrayType(T.IntegerType()))])
    own = rows.filter(F.size("v") == size).mapInArrow(run, schema)
    return own.union(rows.filter(F.size("v") != size).withColumn("parts", F.array(-F.size("v"))))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, params: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    Ties go to the smaller vec_id. Rows that repeat a vec_id are rows of their own, as queries and as
    candidates, so a query may find another row of its id. Rows without an id or with a vector that is
    null, all zero or not finite take no part; vectors are compared with those of their length. Fewer
    candidates give fewer neighbours, empty tables none. Other columns are left out.
    """
    spark, rows = vectors.sparkSession, usable(vectors)
    if rows.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, net, mass = fit(rows, params)
    index = save(routed(rows, size, net, 0.0).withColumn("part", F.col("parts")[0]).drop("parts"), "index")
    asked = routed(rows.filter(F.col("vec_id") % every == 0), size, net, mass)
    queries = save(asked.select("row", F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode("parts").alias("part")), "routed")

    # counts of the parts of either table, which `least_sampled` and the lengths bound, set the blocks
    n_rows = {r["part"]: -(-r["count"] // params.block_rows) for r in index.groupBy("part").count().collect()}
    n_asked = {r["part"]: -(-r["count"] // params.block_queries) for r in queries.groupBy("part").count().collect()}
    blocks = spark.createDataFrame([(p, n_rows[p], n_asked[p]) for p in n_rows if p in n_asked], "part int, rows int, asked int")
    deal = lambda df, own, other: (
        df.join(F.broadcast(blocks), "part")
        .withColumn(own, F.pmod(F.xxhash64("row"), F.col(own)).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    )
    left = deal(queries, "asked", "rows").groupBy("part", "rows", "asked")
    right = deal(index, "rows", "asked").groupBy("part", "rows", "asked")

    def compare(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return _best(q, r, k)

    found = left.cogroup(right).applyInPandas(compare, "query_row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of each query. A product of matrices sorts out all that can't be among them;
    the rest are scored pair by pair, so that equal vectors tie exactly."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    ids, id_rows = queries["query_id"].to_numpy(), queries["row"].to_numpy()
    if len(queries) and len(rows):
        rows = rows.sort_values("vec_id", kind="stable")
        own, own_row, x = rows["vec_id"].to_numpy(), rows["row"].to_numpy(), _scaled(np.stack(rows["v"].to_numpy()))
        q = _scaled(np.stack(queries["q"].to_numpy()))
        x_norm, q_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        for at in range(0, len(ids), 64):
            part = slice(at, at + 64)
            s = (q[part] / q_norm[part, None]) @ (x / x_norm[:, None]).T
            s[id_rows[part, None] == own_row[None, :]] = -np.inf
            least = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
            for i, j in enumerate(range(at, min(at + 64, len(ids)))):
                near = np.flatnonzero((s[i] >= least[i] - 1e-9) & (s[i] > -np.inf))
                score = (x[near] * q[j]).sum(axis=1) / (x_norm[near] * q_norm[j])
                top = np.lexsort((own[near], -score))[:k]
                out.append((np.full(len(top), j), own[near[top]], score[top]))
    place, found, score = (np.concatenate(a) for a in zip(*out, strict=True))
    return pd.DataFrame({"query_row": id_rows[place], "query_id": ids[place], "vec_id": found, "score": score})


def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
