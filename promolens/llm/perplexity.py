"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model.

Words are told apart by XXH64 and bigrams by 63 bits of a mix of their words (two of a billion words
agree with a chance of 3 %). The words most frequent in trusted texts are numbered and every worker
holds what the model knows of them, as of the most frequent bigrams of such words, up to stated bounds;
the tables of all other words and bigrams have no bound and stay sharded. These bounded tables are files
that each worker reads from the shared folder itself; none of them passes through the driver. Scoring is additive: a
document's log-probability is a sum over words of the unigram level and the back-off weight, plus
for each bigram that the model has seen a gain over backing off. What needs these facts only is
summed where the text is read; bitmaps of fixed size drop most other words and bigrams that the
model doesn't know; the rest meet the sharded tables in one join, for which these are written as one in
buckets, so that only the documents' side is shuffled. What this join would ask for too often is found by
a count over all documents before and is looked up in place as well. A trusted document is scored without its own
bigram counts, so that training on it gives it no lead; a bigram that no other trusted document
holds then gains nothing there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.common import discard, kept, save, save_buckets, save_path, saved_arrays, saved_files, ship_by_value, small_batches, sorted_buckets, table, text_slices
from promolens.operators.ranks import with_before

ship_by_value(__name__)

WORD_BITS = 20
WORDS = 1 << WORD_BITS  # numbers of words are below; so many words at least share what is left for unseen ones
BITMAP_BITS = 28  # of the bitmap of all known keys
FEWER_BITS = 2  # by which that of keys that several documents hold is smaller
PIECE_BITS = 15  # of a bitmap that travel together
TRAIN_BYTES = 4 << 20  # of trusted texts whose words a worker holds at a time
TRAIN_ROWS = 2000  # of them that it is handed at a time
PIECES = (1 << (BITMAP_BITS - PIECE_BITS)) + (1 << (BITMAP_BITS - FEWER_BITS - PIECE_BITS))


@dataclass
class Params:
    quantile: float = 0.9  # of each language's perplexities; documents above it are rejected
    hot: int = 1 << 20  # bound on the most frequent bigrams of numbered words, looked up where the text is read
    hot_words: int = 1 << 19  # bound on the most frequent words, which are numbered; below WORDS
    heavy: int = 1000  # keys of the sharded tables asked for more often than once in so many documents are looked up in place
    broadcast_ids: int = 2_000_000  # trusted ids that are broadcast; more are joined by shuffling


def _bytes(strings: pa.StringArray) -> list[bytes]:
    """Of strings without nulls; to_pylist() takes several times as long."""
    _, ends, data = strings.buffers()
    at = np.frombuffer(ends, np.int32, len(strings) + 1, 4 * strings.offset) if len(strings) else np.zeros(1, np.int32)
    held = memoryview(data)[at[0] : at[-1]].tobytes() if data else b""
    at = (at - at[0]).tolist()
    return [held[a:b] for a, b in zip(at, at[1:])]  # noqa: B905


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased words between white space: 64-bit ids of the distinct ones, none in 0..WORDS-1; and for
    each word of the texts in order its place among them and its text's place."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    flat, owner = words.flatten(), np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    ids = np.fromiter(map(xxhash.xxh64_intdigest, _bytes(coded.dictionary)), np.uint64, len(coded.dictionary)).view(np.int64)
    place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where((ids >= 0) & (ids < WORDS), ids + WORDS, ids), place, owner[real.to_numpy(zero_copy_only=False)]


def _cold(x: np.ndarray | Column) -> np.ndarray | Column:
    """Whether words have no number."""
    return (x < 0) | (x >= WORDS)


def _numbered(ids: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """ids with those of the sorted hot ones replaced by their place there, from 1."""
    at = np.minimum(np.searchsorted(hot, ids), max(len(hot) - 1, 0))
    return np.where(hot[at] == ids, at + 1, ids) if len(hot) else ids


def _before(place: np.ndarray, owner: np.ndarray, start: int) -> np.ndarray:
    """The place of the word before each one, `start` at the beginning of a text."""
    first = np.concatenate(([True], owner[1:] != owner[:-1]))[: len(owner)]
    return np.where(first, start, np.concatenate(([start], place[:-1]))[: len(place)])


def _key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A bigram's key: of two numbered words both numbers, else a negative mix of their ids. With w = 0, a cold word's own."""
    x = v.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = ((x ^ (x >> np.uint64(31))) + w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (x ^ (x >> np.uint64(29))) | np.uint64(1 << 63)
    return np.where(_cold(v) | _cold(w), mixed.view(np.int64), (v << WORD_BITS) | w)


def _first(key: np.ndarray | Column, v: np.ndarray | Column) -> np.ndarray | Column:
    """The first word of a bigram, where only keys below 0 come with it."""
    return F.when(key >= 0, F.shiftright(key, WORD_BITS)).otherwise(v) if isinstance(key, Column) else np.where(key >= 0, key >> WORD_BITS, v)


def _second(key: np.ndarray | Column, w: np.ndarray | Column) -> np.ndarray | Column:
    return F.when(key >= 0, key.bitwiseAND(F.lit(WORDS - 1))).otherwise(w) if isinstance(key, Column) else np.where(key >= 0, key & (WORDS - 1), w)


def discounts(counts: np.ndarray) -> np.ndarray:
    """D(1), D(2), D(3+) from the numbers of n-grams seen once to four times (Chen and Goodman)."""
    n1, n2, n3, n4 = (float(max(c, 1)) for c in counts)
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0.05, 0.1, 0.15], [0.95, 1.9, 2.85])


LEVELS = ["total", "once", "twice", "more", "before"]


@dataclass
class Levels:
    """What Lower is made from."""

    near: str  # path of the rows (id, *LEVELS) of numbered words
    d: np.ndarray  # discounts of bigrams
    e: np.ndarray  # and of the words before a word
    rest: np.ndarray  # such words in all, an unknown word's probability


class Lower:
    """The levels below the bigrams for numbered words: probability, count held back as a context, logarithms of
    the former and of the back-off weight; and of an unknown word's probability."""

    @classmethod
    def made(cls, total: np.ndarray, once: np.ndarray, twice: np.ndarray, more: np.ndarray, before: np.ndarray, d: np.ndarray, e: np.ndarray, rest: np.ndarray) -> Lower:
        mass, floor = rest
        p = (before - np.concatenate(([0.0], e))[np.minimum(before, 3)]) / mass + floor
        held = d[0] * once + d[1] * twice + d[2] * more
        return cls(p, held, np.log(p), np.log(np.where(total > 0, held / np.maximum(total, 1), 1.0)), np.append(d, np.log(floor)))

    @classmethod
    def read(cls, levels: Levels) -> Lower:
        at, *counts = saved_arrays(levels.near, "id", *LEVELS)
        dense = np.zeros((len(LEVELS), max(at, default=0) + 1), np.int64)
        for row, count in zip(dense, counts, strict=True):
            row[at] = count
        return cls.made(*dense, levels.d, levels.e, levels.rest)

    def __init__(self, p: np.ndarray, held: np.ndarray, log_p: np.ndarray, log_back: np.ndarray, rest: np.ndarray) -> None:
        self.p, self.held, self.log_p, self.log_back = p, held, log_p, log_back
        self.d, self.log_floor = rest[:3], float(rest[3])

    def gain(self, count: np.ndarray, held: np.ndarray, p: np.ndarray) -> np.ndarray:
        """What a bigram seen `count` times adds to backing off; 0 where the count is 0."""
        seen = np.maximum(count - np.concatenate(([0.0], self.d))[np.clip(count, 0, 3)], 0)
        rest = np.where(count > 0, held * p, 1.0)
        return np.where(count > 0, np.log1p(seen / rest), 0.0)


def _bits(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def most_frequent(counted: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the largest counts, at most `most`: all whose count reaches a step of a 64th of an
    octave. Only the number of rows of each step, 4,096 at most, is gathered."""
    step = F.floor(F.log2(count) * 64).cast("int")
    left, least = most, None
    for r in sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    return counted.filter(step >= least) if least is not None else counted.limit(0)


def frequent_words(texts: DataFrame, most: int) -> str:
    """The path of a table of the ids of the words of column text that occur most often, at most `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=TRAIN_BYTES):
            ids, place, _ = tokens(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(place, minlength=len(ids)))], ["id", "n"])

    counts = texts.select("text").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    with small_batches(texts.sparkSession, TRAIN_ROWS):
        counts = save(counts, "words")
    found = save_path(most_frequent(counts, "n", most).select("id"), "numbered")
    discard(counts)
    return found


def sorted_ids(path: str) -> np.ndarray:
    return np.sort(saved_arrays(path, "id")[0])


def count_bigrams(texts: DataFrame, numbered: str) -> DataFrame:
    """(key, v, w, count, docs) of the bigrams of column text: how often each occurs, and in how many
    rows; v and w are 0 where the key has them. A table in the shared folder, in buckets by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = kept(numbered, lambda: sorted_ids(numbered))
        for batch in text_slices(batches, limit=TRAIN_BYTES):
            ids, place, owner = tokens(batch.column(0))
            ids = np.append(_numbered(ids, hot), 0)
            v, w = ids[_before(place, owner, len(ids) - 1)], ids[place]
            key = _key(v, w)
            order = np.argsort(key, kind="stable")  # within a key, by text
            key, owner = key[order], owner[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
            text = new | np.concatenate(([True], owner[1:] != owner[:-1]))[: len(key)]
            at = np.flatnonzero(new)
            n, docs = np.diff(np.append(at, len(key))), np.add.reduceat(text.astype(np.int64), at) if len(at) else at
            near, at = key[at] >= 0, order[at]
            columns = [key[new], np.where(near, 0, v[at]), np.where(near, 0, w[at]), n, docs]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["key", "v", "w", "count", "docs"])

    counts = texts.select("text").mapInArrow(run, "key long, v long, w long, count long, docs long").groupBy("key")
    counts = counts.agg(F.first("v").alias("v"), F.first("w").alias("w"), F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    with small_batches(texts.sparkSession, TRAIN_ROWS):
        return save_buckets(counts, "bigrams", "key")


def lower_levels(bigrams: DataFrame) -> tuple[Levels, DataFrame]:
    """What Lower is made from, of numbered words only; and a table in buckets by key of what the others
    are needed for: of bigrams the count that the first word holds back and the probability of the
    second, null where these have numbers; of words their log-probability beyond an unknown word's
    and their log back-off weight."""
    bigrams = bigrams.withColumns({"v": _first(F.col("key"), F.col("v")), "w": _second(F.col("key"), F.col("w"))})
    seen = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).alias
    kinds = lambda df, c: [k or 0 for k in df.agg(*[seen(F.col(c) == i)(f"n{i}") for i in range(1, 5)], seen(F.col(c) > 2)("many"), F.sum(c)).first()]
    by_context = bigrams.groupBy(F.col("v").alias("id")).agg(
        F.sum("count").alias("total"), seen(F.col("count") == 1)("once"), seen(F.col("count") == 2)("twice"), seen(F.col("count") > 2)("more")
    )
    by_word = bigrams.groupBy(F.col("w").alias("id")).agg(F.count("*").alias("before"))
    levels = by_context.unionByName(by_word, allowMissingColumns=True).groupBy("id").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in LEVELS])
    levels = save(levels, "levels")
    d = discounts(np.array(kinds(bigrams, "count")[:4]))
    n1, n2, n3, n4, many, mass = kinds(levels, "before")
    e = discounts(np.array([n1, n2, n3, n4]))
    left = float(e @ [n1, n2, many]) / mass if mass else 1.0
    rest = np.array([max(mass, 1), left / max(WORDS, n1 + n2 + many + 1)], float)

    near = save_path(levels.filter(~_cold(F.col("id"))), "near")

    p = (F.col("before") - F.element_at(F.array(*[F.lit(float(x)) for x in e]), F.least("before", F.lit(3)).cast("int"))) / float(rest[0]) + float(rest[1])
    held = F.col("once") * float(d[0]) + F.col("twice") * float(d[1]) + F.col("more") * float(d[2])
    cold = levels.filter(_cold(F.col("id"))).withColumns({"held": held, "p": p})
    back = F.when(F.col("total") > 0, F.log(F.col("held") / F.col("total"))).otherwise(F.lit(0.0))
    none = F.lit(None).cast("double")

    def own_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_key(ids, np.zeros_like(ids))), batch.column("held"), batch.column("p")], ["key", "held", "p"])

    words = cold.select("id", (F.log("p") - F.log(F.lit(float(rest[1])))).alias("held"), back.alias("p"))
    parts = [
        words.mapInArrow(own_key, "key long, held double, p double"),
        bigrams.filter(_cold(F.col("v"))).join(cold.select(F.col("id").alias("v"), "held"), "v").select("key", "held", none.alias("p")),
        bigrams.filter(_cold(F.col("w"))).join(cold.select(F.col("id").alias("w"), "p"), "w").select("key", none.alias("held"), "p"),
    ]
    facts = parts[0].union(parts[1]).union(parts[2]).groupBy("key").agg(F.max("held").alias("held"), F.max("p").alias("p"))
    facts = save_buckets(facts, "cold", "key")
    discard(levels)
    return Levels(near, d, e, rest), facts


def all_facts(bigrams: DataFrame, cold: DataFrame) -> DataFrame:
    """One table in buckets by key in place of both, which go: (key, v, w, count, held, p). Of the first and second
    words of bigrams that have a word without a number only numbers are left; words without are -1."""
    near = [F.when(_cold(F.col(c)), F.lit(-1)).otherwise(F.col(c)).alias(c) for c in ("v", "w")]
    spark = bigrams.sparkSession
    with sorted_buckets(spark):
        facts = save_buckets(bigrams.select("key", *near, "count").hint("merge").join(cold, "key", "full"), "facts", "key")
    discard(bigrams)
    discard(cold)
    return facts


def bitmaps(keys: DataFrame) -> str:
    """Two bitmaps of the hashes of the rows (key, docs): of all, and of those that several documents hold.

    A task holds both and sends what it has of them in pieces of 2^15 bits; each piece is put together
    in one place. The path of a table of at most 8192 + 2048 pieces of 4 KB, for read_bitmaps().
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros((PIECES, 1 << PIECE_BITS >> 3), np.uint8)
        for batch in batches:
            bits, several = _bits(batch.column("key").to_numpy()), batch.column("docs").to_numpy() > 1
            bits = np.concatenate([bits, (bits[several] >> FEWER_BITS) + (1 << BITMAP_BITS)])
            np.bitwise_or.at(flags.reshape(-1), bits >> 3, np.uint8(1) << (bits & 7).astype(np.uint8))
        at = np.flatnonzero(flags.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([zlib.compress(flags[i].tobytes(), 1) for i in at], pa.binary())], ["piece", "bits"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made[piece] = made.get(piece, 0) | np.frombuffer(zlib.decompress(bits), np.uint8)
        packed = [x.tobytes() for x in made.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array(packed, pa.binary())], ["piece", "bits"])

    fields = "piece long, bits binary"
    return save_path(keys.mapInArrow(deal, fields).repartition("piece").mapInArrow(put, fields), "bitmaps")


def read_bitmaps(path: str) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((PIECES, 1 << PIECE_BITS >> 3), np.uint8)
    for rows in saved_files(path):
        for batch in rows.to_batches():
            if batch.num_rows:
                bits = batch.column("bits").cast(pa.binary(out.shape[1]))
                out[batch.column("piece").to_numpy()] = np.frombuffer(bits.buffers()[1], np.uint8, len(bits) * out.shape[1], bits.offset * out.shape[1]).reshape(-1, out.shape[1])
    return tuple(np.split(out.reshape(-1), [1 << BITMAP_BITS >> 3]))


@dataclass
class Paths:
    """Of the tables of bounded size that each worker holds."""

    levels: Levels
    numbered: str
    hot: str
    bitmaps: str
    raised: str = ""


FACTS = ["key", "v", "w", "count", "held", "p"]


class Lookups:
    """What is looked up where the text is read: numbered words, the hot bigrams and their counts, the bitmaps of
    known keys and of those that several documents hold, raised keys and their facts."""

    def __init__(self, paths: Paths) -> None:
        self.model, self.numbered = Lower.read(paths.levels), sorted_ids(paths.numbered)
        self.hot, counts = _by_key(*saved_arrays(paths.hot, "key", "count"))
        self.hot_counts = counts.astype(np.int32)
        self.known, self.several = read_bitmaps(paths.bitmaps)
        self.raised, *self.facts = _by_key(*saved_arrays(paths.raised, *FACTS)) if paths.raised else [None]

    @classmethod
    def held(cls, paths: Paths) -> Lookups:
        return kept(f"{paths.bitmaps} {paths.raised}", lambda: cls(paths))


def _by_key(key: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(key)
    return [x[order] for x in (key, *more)]


def heavy_keys(texts: DataFrame, paths: Paths, share_of: int, n_docs: int) -> DataFrame:
    """key: what the sharded tables would be asked for at least n_docs / share_of times, as occurrences.

    A key of such a share has it in some part of the texts too, so each part names only those of its own share
    that occur twice; both words of such a bigram occur as often. One that is missed occurs at most once in each
    part of 8 MB beside its share. There are at most share_of times as many as a document has words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Lookups.held(paths)
        numbered, hot, known = at.numbered, at.hot, at.known
        for batch in text_slices(batches, limit=8 << 20):
            ids, place, owner = tokens(batch.column(0))
            ids, least = np.append(_numbered(ids, numbered), 0), max(2, batch.num_rows / share_of)
            before = _before(place, owner, len(ids) - 1)
            times = np.bincount(place, minlength=len(ids))
            times[-1] = batch.num_rows  # beginnings of texts, at most
            often = times >= least
            both = np.flatnonzero(often[before] & often[place])
            pairs, n = np.unique(_key(ids[before[both]], ids[place[both]]), return_counts=True)
            pairs, n = pairs[n >= least], n[n >= least]
            lone = np.flatnonzero(often & _cold(ids))
            keys, n = np.concatenate([pairs, _key(ids[lone], np.zeros(len(lone), np.int64))]), np.concatenate([n, times[lone]])
            keep = _marked(known, _bits(keys))
            if len(hot):
                keep &= hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] != keys
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(n[keep].astype(np.int64))], ["key", "n"])

    counts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    with small_batches(texts.sparkSession, 4000):
        return save(counts.filter(F.col("n") * share_of >= n_docs).select("key"), "heavy")


def _gained(model: Lower, key: np.ndarray, n: np.ndarray, follows: np.ndarray, v: np.ndarray, w: np.ndarray, count: np.ndarray, held: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What rows gain from the facts found under their keys: of bigrams (follows below 0) and of cold words."""
    pair, v, w = follows < 0, _first(key, v), _second(key, w)
    near_v, near_w = pair & ~_cold(v), pair & ~_cold(w)
    of_v, of_w = np.where(near_v, model.held[np.where(near_v, v, 0)], held), np.where(near_w, model.p[np.where(near_w, w, 0)], p)
    seen = np.where(pair, np.maximum(count + np.minimum(n, 0), 0), 0)
    return np.where(pair, np.abs(n) * model.gain(seen, of_v, of_w), n * held + follows * p)


def _marked(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1


def score(docs: DataFrame, trusted: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, lang, n_words, perplexity, keep for each row of docs; trusted: a column doc_id.

    Rows that repeat a doc_id, or have none, are documents of their own; all rows of a trusted id are
    trusted. Null texts have no words and perplexity 1; they are kept. Null languages are one language
    of their own, the empty one. With no trusted text all words are equally likely. Other columns are
    left out. An empty table gives no rows. Rows are numbered as they are read: docs should be a table
    that is read, not the outcome of a shuffle.
    """
    spark = docs.sparkSession
    ids = save(trusted.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("own", F.lit(True)), "trusted")
    if ids.count() <= params.broadcast_ids:
        ids = F.broadcast(ids)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    # languages are told apart by 64 bits as words are: sums of a document are then of fixed width
    marked = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(lang).alias("lang"), F.col("text").cast("string").alias("text"))
    marked = marked.join(ids, "doc_id", "left")
    langs = save(docs.select(F.xxhash64(lang).alias("lang"), lang.alias("name")).distinct().groupBy("lang").agg(F.max("name").alias("name")), "langs")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi")
    numbered = frequent_words(texts, min(params.hot_words, WORDS - 1))
    bigrams = count_bigrams(texts, numbered)
    levels, cold = lower_levels(bigrams)
    # files in place of broadcasts, of which each executor keeps a copy on disk
    hot = save_path(most_frequent(bigrams.filter("key >= 0"), "count", params.hot).select("key", "count"), "hot")
    judged = Paths(levels, numbered, hot, bitmaps(bigrams.select("key", "docs").union(cold.select("key", F.lit(1).cast("long")))))
    heavy = heavy_keys(docs, judged, params.heavy, docs.count())
    facts = all_facts(bigrams, cold)
    # at most `heavy` times as many keys as a document has words: the table stays in place
    paths = replace(judged, raised=save_path(facts.join(F.broadcast(heavy), "key").select(*FACTS), "raised"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Lookups.held(paths)
        model, numbered, hot, hot_counts, known, several, raised, facts = at.model, at.numbered, at.hot, at.hot_counts, at.known, at.several, at.raised, at.facts
        for batch in text_slices(batches, limit=2 << 20):
            ids, place, owner = tokens(batch.column("text"))
            ids, n_docs = np.append(_numbered(ids, numbered), 0), batch.num_rows
            far = _cold(ids)
            known_at = np.where(far, 0, ids)
            before = _before(place, owner, len(ids) - 1)
            log_p, log_back = np.where(far, model.log_floor, model.log_p[known_at]), np.where(far, 0.0, model.log_back[known_at])
            ll = np.bincount(owner, log_p[place] + log_back[before], n_docs).astype(np.float64)
            pairs, pair = np.unique(_key(ids[before], ids[place]), return_inverse=True)
            at = np.minimum(np.searchsorted(hot, pairs), max(len(hot) - 1, 0))
            here = (hot[at] == pairs) if len(hot) else np.zeros(len(pairs), bool)
            v, w = np.where(here, _first(pairs, 0), 0), np.where(here, _second(pairs, 0), 0)
            count = np.where(here, hot_counts[at], 0).astype(np.int64) if len(hot) else np.zeros(len(pairs), np.int64)
            own = batch.column("own").is_valid().to_numpy(zero_copy_only=False)
            mine = own[owner]
            ll += np.bincount(owner, np.where(mine, 0.0, model.gain(count, model.held[v], model.p[w])[pair]), n_docs)

            # by document and bigram: what the tables are needed for, and in a trusted text the bigrams looked up here
            bits = _bits(pairs)
            asked = np.where(mine, (here | _marked(several, bits >> FEWER_BITS))[pair], (~here & _marked(known, bits))[pair])
            both, n = np.unique(owner[asked] * len(pairs) + pair[asked], return_counts=True)
            doc, pair = (both // len(pairs), both % len(pairs)) if len(pairs) else (both, both)
            near = here[pair]
            seen = count[pair[near]] - n[near]
            ll += np.bincount(doc[near], n[near] * model.gain(seen, model.held[v[pair[near]]], model.p[w[pair[near]]]), n_docs)
            doc, pair, n = doc[~near], pair[~near], n[~near]

            # cold words that the model knows, and how often another word follows them
            heard = far & _marked(known, _bits(_key(ids, np.zeros_like(ids))))
            last = np.concatenate((owner[1:] != owner[:-1], [True]))[: len(owner)]
            lone = heard[place]
            words, back, times = np.unique(owner[lone] * len(ids) + place[lone], return_inverse=True, return_counts=True)
            follows = times - np.bincount(back, last[lone], len(words)).astype(np.int64)

            # a row for each of both; those under raised keys are settled here
            of = np.concatenate([doc, words // len(ids)])
            key = np.concatenate([pairs[pair], _key(ids[words % len(ids)], np.zeros_like(words))])
            n, follows = np.concatenate([np.where(own[doc], -n, n), times]), np.concatenate([np.full(len(doc), -1), follows])
            at = np.minimum(np.searchsorted(raised, key), max(len(raised) - 1, 0))
            settled = (raised[at] == key) if len(raised) else np.zeros(len(key), bool)
            found = [x[at[settled]] for x in facts]
            ll += np.bincount(of[settled], _gained(model, key[settled], n[settled], follows[settled], *found), n_docs)
            of, key, n, follows = (x[~settled] for x in (of, key, n, follows))

            doc_rows, size = batch.column("row").to_numpy(), np.bincount(owner, minlength=n_docs)
            # the sums travel with these, under keys that spread them over the tasks
            spread = -np.random.default_rng(n_docs).integers(1, 1 << 62, n_docs)
            columns = [doc_rows[np.concatenate([np.arange(n_docs), of])], np.concatenate([spread, key]), np.concatenate([size, n]), np.concatenate([np.zeros(n_docs, np.int64), follows])]
            pad = len(of)
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(c.astype(np.int64)) for c in columns],
                    pa.concat_arrays([pa.array(ll), pa.nulls(pad, pa.float64())]),
                    pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), pa.nulls(pad, pa.int64())]),
                    pa.concat_arrays([batch.column("lang"), pa.nulls(pad, pa.int64())]),
                ],
                ["row", "key", "n", "follows", "ll", "doc_id", "lang"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(levels.near, lambda: Lower.read(levels))
        for batch in batches:
            key, n, follows = (batch.column(c).to_numpy() for c in ("key", "n", "follows"))
            ll, v, w, count, held, p = (batch.column(c).fill_null(0).to_numpy() for c in ("ll", "v", "w", "count", "held", "p"))
            whole = batch.column("lang").is_valid().to_numpy(zero_copy_only=False)
            gained = _gained(model, key, n, follows, v, w, count, held, p)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("lang"), pa.array(np.where(whole, n, 0)), pa.array(np.where(whole, ll, gained))],
                ["row", "doc_id", "lang", "n_words", "ll"],
            )

    # n: of a document's sums its words, of a bigram how often it occurs (below 0 in a trusted text), of a word the same
    rows = marked.mapInArrow(read, "row long, key long, n long, follows long, ll double, doc_id long, lang long")
    met = rows.join(facts.hint("merge"), "key", "left").mapInArrow(add, "row long, doc_id long, lang long, n_words long, ll double")
    sums = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("lang").alias("lang"), F.sum("n_words").alias("n_words"), F.sum("ll").alias("ll"))
    sums = sums.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("ll") / F.col("n_words"))).otherwise(F.lit(1.0)))
    with small_batches(spark, 4000), sorted_buckets(spark):
        sums = save(sums.drop("ll", "row"), "perplexity")
    # the exact rank, over ranges of (lang, perplexity)
    placed = with_before(sums.select("lang", "perplexity"), ["lang"], ["perplexity"], F.lit(1).cast("long"), "rank")
    n = sums.groupBy("lang").agg((F.greatest(F.ceil(F.count("*") * params.quantile), F.lit(1)) - 1).alias("rank"))
    limits = save(placed.join(n, ["lang", "rank"]).groupBy("lang").agg(F.max("perplexity").alias("limit")), "limits")
    return sums.join(limits.join(langs, "lang"), "lang").select("doc_id", F.col("name").alias("lang"), "n_words", "perplexity", (F.col("perplexity") <= F.col("limit")).alias("keep"))


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, trusting those labelled of quality 1."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return score(table(spark, sf_dir, "documents"), trusted)
