"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded sample of labelled documents, as many of either class, chosen by a hash of
the id, and reads their whole texts. A first pass counts in how many toxic and other documents each n-gram (of case-folded
characters, whatever their bytes) occurs; the n-grams with the strongest evidence become features, each scaled by its
smoothed log-count ratio; a logistic regression over the scaled presence features sets the
weights (Wang and Manning, 2012). Scoring walks every whole text: a table over hash buckets drops
nearly all positions, the rest are looked up exactly. The model is broadcast; its size is fixed
by `features`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.llm.common import save, ship_by_value, slices, table, with_fields

ship_by_value(__name__)

SIZES = (3, 4, 5, 6)  # characters in an n-gram
BUCKETS = 20  # bits of the table that drops positions without features
CHUNK = 1 << 20  # characters of text hashed at once


@dataclass
class Params:
    sample_rows: int = 3000  # bound on the training documents of either class
    features: int = 20_000
    min_docs: int = 5  # sampled documents that hold a feature
    min_z: float = 5.0  # of the difference between the classes' shares; chance passes it about once in two million n-grams
    tasks: int = 48  # that share the training texts
    l2: float = 1.0
    steps: int = 300


def _hashes(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of each size, in chunks that overlap so that none is lost."""
    longest = max(SIZES)
    for at in range(0, max(len(text) - longest + 1, 1), CHUNK):
        b = np.frombuffer(text[at : at + CHUNK + longest - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
        h = np.zeros(len(b), np.uint64)
        for n in range(1, longest + 1):
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + b[n - 1 :] + np.uint64(1)
            if n in SIZES:
                yield h ^ (h >> np.uint64(29))


def _lower(text: bytes | None) -> str:
    """Words between single spaces, case-folded; bytes that are no UTF-8 count as U+FFFD."""
    return " ".join(["", *(text or b"").decode(errors="replace").casefold().split(), ""])


def _distinct(text: str) -> np.ndarray:
    """The text's distinct hashes; repeated ones of a very long text are dropped as it is walked."""
    parts, size, limit = [np.zeros(0, np.uint64)], 0, 4 * CHUNK
    for h in _hashes(text):
        parts.append(h)
        size += len(h)
        if size > limit:
            parts = [np.unique(np.concatenate(parts))]
            size, limit = len(parts[0]), 2 * len(parts[0]) + 4 * CHUNK
    return np.unique(np.concatenate(parts))


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray  # ratio x regression weight
    bias: float
    flags: np.ndarray | None = None

    def score(self, text: str) -> float:
        if self.flags is None:
            self.flags = np.zeros(1 << BUCKETS, bool)
            self.flags[self.keys >> np.uint64(64 - BUCKETS)] = True
        hits = [h[self.flags[h >> np.uint64(64 - BUCKETS)]] for h in _hashes(text)]
        near = np.unique(np.concatenate([*hits, np.zeros(0, np.uint64)]))
        z = self.bias
        if len(near) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, near), len(self.keys) - 1)
            z += float(self.weights[at[self.keys[at] == near]].sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def sample(docs: DataFrame, labels: DataFrame, rows: int, seed: int = 5) -> tuple[DataFrame, list[int]]:
    """(doc_id, toxic) of at most `rows` documents of either class, in order of a hash of the id, and the
    number of labelled documents of either class. Labels of ids that docs lacks, and ids labelled both
    ways, are left out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id")
    known = known.agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = save(known.withColumn("at", F.xxhash64(F.lit(seed), "doc_id")), "labels")
    parts = [known.filter(F.col("toxic") == c).orderBy("at", "doc_id").limit(rows).drop("at") for c in (0, 1)]
    return save(parts[0].union(parts[1]), "sample"), [known.filter(F.col("toxic") == c).count() for c in (0, 1)]


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """Train on the labelled documents found in docs.

    Where either class has none there is nothing to learn: all documents get one score below a half,
    so that no filter drops them. Null texts count as empty. Of rows that repeat an id the smallest
    text is trained on. Rows without id, or with a label other than 0 and 1, aren't.
    """
    chosen, totals = sample(docs, labels, params.sample_rows)
    if not all(totals):
        return Model(np.zeros(0, np.uint64), np.zeros(0), -float(np.log(sum(totals) + 2)))
    sizes = [min(n, params.sample_rows) for n in totals]
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    # at most 2 x sample_rows small rows: a size that holds for any input
    texts = texts.join(F.broadcast(chosen), "doc_id")
    # one text of each id is left in every task before any is dealt out
    texts = save(texts.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")), "train")
    texts = texts.repartition(params.tasks, "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])

        def counted() -> pa.RecordBatch:
            out = []
            for c in (0, 1):
                keys, n = np.unique(np.concatenate([*held[c], np.zeros(0, np.uint64)]), return_counts=True)
                out.append((keys.view(np.int64), n if c == 0 else np.zeros_like(n), n if c == 1 else np.zeros_like(n)))
                held[c].clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["key", "other", "toxic"])

        size = 0
        for batch in slices(batches, 64):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                held[y].append(_distinct(_lower(text)))
                size += len(held[y][-1])
                if size > 4 * CHUNK:
                    yield counted()
                    size = 0
        yield counted()

    counts = texts.mapInArrow(count, "key long, other long, toxic long").groupBy("key")
    counts = counts.agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).filter(F.col("other") + F.col("toxic") >= params.min_docs)
    pooled = (F.col("toxic") + F.col("other")) / float(sum(sizes))
    apart = F.abs(F.col("toxic") / float(sizes[1]) - F.col("other") / float(sizes[0]))
    z = apart / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * float(1 / sizes[0] + 1 / sizes[1]))
    best = counts.withColumn("z", z).filter(F.col("z") >= params.min_z).orderBy(F.desc("z"), "key")
    top = best.limit(params.features).select("key", "other", "toxic").collect()
    keys = np.array([r.key for r in top], np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, other, toxic = keys[order], np.array([r.other for r in top], float)[order], np.array([r.toxic for r in top], float)[order]
    ratios = np.log((toxic + 1) / (sizes[1] + 2)) - np.log((other + 1) / (sizes[0] + 2))
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        for batch in slices(batches, 64):
            rows = []
            for text in batch.column("text").to_pylist():
                grams = _distinct(_lower(text))
                at = np.minimum(np.searchsorted(keys, grams), max(len(keys) - 1, 0))
                rows.append(at[keys[at] == grams].astype(np.int32) if len(keys) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "toxic", "at"])

    # gathered: at most 2 x sample_rows rows, each of as many numbers as it holds of the `features`
    schema = T.StructType([docs.schema["doc_id"], chosen.schema["toxic"], T.StructField("at", T.ArrayType(T.IntegerType()))])
    rows = texts.mapInArrow(present, schema).orderBy("doc_id").toArrow()
    flat = rows.column("at").combine_chunks()
    columns = flat.values.to_numpy(zero_copy_only=False)[flat.offsets[0].as_py() :]
    owner = np.repeat(np.arange(rows.num_rows), np.diff(flat.offsets.to_numpy()))
    weights, bias = _regress(owner, columns, rows.column("toxic").to_numpy().astype(float), ratios, params)
    # the sample shows the classes as often as `sizes` has it, the documents as `totals`
    return Model(keys, weights * ratios, bias + float(np.log(totals[1] / totals[0]) - np.log(sizes[1] / sizes[0])))


def _regress(owner: np.ndarray, column: np.ndarray, y: np.ndarray, ratios: np.ndarray, params: Params) -> tuple[np.ndarray, float]:
    """Logistic regression over presence x ratio with an L2 penalty, by Adam on the full sample."""
    n, value = len(y), ratios[column]
    w, b = np.zeros(len(ratios)), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, params.steps + 1):
        z = np.bincount(owner, value * w[column], n) + b
        err = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        grad = np.append(np.bincount(column, value * err[owner], len(w)) / n + params.l2 * w / n, err.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the column `name` in 0..1, which replaces one that docs has of this name.

    Null texts count as empty. Rows are scored by their texts alone, so null and repeated ids and
    repeated rows keep their own score; an empty table gives no rows.
    """
    schema = with_fields(docs.schema, T.StructField(name, T.DoubleType()))
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in slices(batches):
            made = pa.array([model.score(_lower(t)) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([made if f.name == name else batch.column(f.name) for f in schema], [f.name for f in schema])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether an id's labels are kept from training: its text's CRC-32 is a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train_on_seen(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    return fit(docs, labels.filter(~held_out(F.col("doc_id"))), params)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train_on_seen(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
