"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words and put into one automaton over word numbers. Documents are
streamed through it: at each word the state and the longest length that matches an item's text
are known, so every occurrence of a window (ten consecutive item words, or a whole shorter
item) is found in one pass, together with the items that hold it. Only runs of words that occur
in some item are walked; a window can't reach beyond such a run.

The items are gathered to the driver in blocks of at most `block_words` words and broadcast, one
block per pass over the documents. Long items are cut into overlapping pieces, which keeps every
window, so a block's size has a bound whatever the table holds. With several blocks the documents
are written once with a row number; each pass reads their texts and writes the rows that it hits.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.llm.common import save, ship_by_value, slices, table, text_or_empty, with_fields

ship_by_value(__name__)

#: Bytes to bytes: A-Z lower-cased; ASCII other than letters and digits becomes a space.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
BLOCK_WORDS = 200_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """Generalised suffix automaton over item words, with the items of each window.

    Pieces are (item id, words, whole): `whole` marks items shorter than the window, which count
    only as a whole.
    """

    def __init__(self, pieces: list[tuple[str | None, list[bytes], bool]], window: int) -> None:
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words, whole in pieces:
            codes = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            coded.append((item, codes, whole))
            last = 0
            for c in codes:
                last = self._extend(last, c)
        states = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        # the state of a match's last `window` words
        self.at_window = [0] * len(self.length)
        for v in states:
            if self.length[v] >= window:
                u = self.link[v]
                self.at_window[v] = v if self.length[u] < window else self.at_window[u]
        self.items: dict[int, set] = {}
        ends: dict[int, dict[int, set]] = {}
        for item, codes, whole in coded:
            v = 0
            for i, c in enumerate(codes):
                v = self.next[v][c]
                if not whole and i + 1 >= window:
                    self.items.setdefault(self.at_window[v], set()).add(item)
            if whole:
                ends.setdefault(v, {}).setdefault(len(codes), set()).add(item)
        # whole short items that end a match at this state, longest first: (words, ids)
        self.short: list[tuple] = [()] * len(self.length)
        for v in states:
            self.short[v] = tuple(sorted(ends.get(v, {}).items(), reverse=True)) + self.short[self.link[v]]
        self.least = min((len(c) if whole else window for _, c, whole in coded), default=0)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = self._add(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _add(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        r = self._add(self.length[p] + 1)
        self.next[r] = dict(self.next[q])
        self.link[r] = self.link[q]
        self.link[q] = r
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        return r

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans [start, end) of words inside window occurrences, and the ids of their items."""
        if not self.least or len(words) < self.least:
            return [], set()
        codes = np.fromiter(map(self.vocab.get, words, _minus_ones()), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        found: set = set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.least:
                continue
            v = matched = 0
            for i, c in enumerate(codes[a:b].tolist(), a + 1):
                while v and c not in nxt[v]:
                    v = link[v]
                    matched = length[v]
                if c in nxt[v]:
                    v = nxt[v][c]
                    matched += 1
                size = 0
                if matched >= window:
                    size = window
                    found |= self.items.get(self.at_window[v], set())
                for n, ids in self.short[v]:
                    if n <= matched:
                        size = max(size, n)
                        found |= ids
                if size:
                    start = i - size
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, found


def _minus_ones() -> Iterator[int]:
    while True:
        yield -1


def item_blocks(items: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[list]:
    """Lists of pieces of the items, each list of at most block_words words, gathered one at a time."""
    long = max(10 * window, 1000)
    fields = "id string, words array<binary>, whole boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for item, text in zip(ids, texts, strict=True):
                words = words_of(text)
                for at in range(0, max(len(words) - window + 1, 1), long):
                    if piece := words[at : at + long + window - 1]:
                        rows.append((item, piece, len(words) < window))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.binary())), pa.array([r[2] for r in rows], pa.bool_())],
                ["id", "words", "whole"],
            )

    pieces = items.select(F.col("item_id").cast("string").alias("id"), text_or_empty().cast("binary").alias("text"))
    # repeated items count once: without their copies no block outgrows its bound
    pieces = pieces.mapInArrow(cut, fields).distinct().withColumn("n", F.size("words"))
    total = pieces.agg(F.sum("n")).first()[0] or 0
    if total <= block_words:
        yield [tuple(r) for r in pieces.drop("n").collect()]
        return
    kept = save(pieces, "pieces")
    share = -(-16 * total // block_words)
    parts = kept.withColumn("part", F.pmod(F.xxhash64("id", "words"), F.lit(share)))
    block, size = [], 0
    # the words of each part are known before it is gathered, so as many parts as fit make a block
    sizes = sorted(parts.groupBy("part").agg(F.sum("n").alias("n")).collect())
    for i, (part, n) in enumerate(sizes):
        block.append(part)
        size += n
        if i + 1 == len(sizes) or size + sizes[i + 1]["n"] > block_words:
            yield [tuple(r) for r in parts.filter(F.col("part").isin(block)).select("id", "words", "whole").collect()]
            block, size = [], 0


_BUILT: dict[str, Automaton] = {}


def _built(key: str, pieces: list, window: int) -> Automaton:
    """This worker's automaton of a block, built once."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(pieces, window)
    return _BUILT[key]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans and what stands between them."""
    flat, out, at = text.translate(NORMAL), [], 0
    starts, ends, i = [], [], 0
    for w in flat.split():
        i = flat.index(w, i)
        starts.append(i)
        i += len(w)
        ends.append(i)
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = ends[b - 1]
    out.append(text[at:])
    return b"".join(out)


NEW = ("n_words", "spans", "item_ids", "coverage", "rejected")
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, clean: bool = False, block_words: int = BLOCK_WORDS, prefix: str = ""
) -> DataFrame:
    """docs with n_words, spans (word numbers, merged, in order), item_ids and coverage; with
    `clean`, text loses the spans, and rejected tells documents whose coverage exceeds max_coverage.
    `prefix` stands before the names of these columns.

    Null texts have no words. Items without words match nothing; a null item_id still marks words
    but isn't listed. Repeated items count once. Rows are independent, so repeated rows and null
    ids keep their own result; input columns of the new names are replaced. Empty tables give no
    spans or no rows.
    """
    n_words, spans, item_ids, coverage, rejected = (prefix + n for n in NEW)
    found = T.StructType([T.StructField(prefix + f.name, f.dataType) for f in FOUND])
    blocks = item_blocks(items, window, block_words)
    first = next(blocks, [])
    more = next(blocks, None)
    if more is None:
        out = _matched(docs, first, window, found)
    else:
        out = _in_passes(docs, itertools.chain([first, more], blocks), window, found)
    covered = F.aggregate(spans, F.lit(0), lambda n, s: n + s[1] - s[0])
    out = out.withColumn(coverage, F.when(F.col(n_words) > 0, covered / F.col(n_words)).otherwise(F.lit(0.0)))
    if not clean:
        return out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, of = batch.schema.get_field_index("text"), batch.column(spans).to_pylist()
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            texts = [_without(t, s) if s else t for t, s in zip(texts, of, strict=True)]
            yield batch.set_column(at, "text", pa.array(texts, pa.binary()).cast(pa.string()))

    return out.mapInArrow(cut, out.schema).withColumn(rejected, F.col(coverage) > max_coverage)


def _with_columns(batch: pa.RecordBatch, made: dict[str, pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names)


def _matched(docs: DataFrame, pieces: list, window: int, found: T.StructType) -> DataFrame:
    """docs with the fields `found`, by one pass with an automaton of the pieces."""
    schema, key, names = with_fields(docs.schema, *found.fields), uuid.uuid4().hex, found.names
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _built(key, shared.value, window)
        for batch in slices(batches):
            counts, spans, ids = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = words_of(text or b"")
                here, items = automaton.matches(words)
                counts.append(len(words))
                spans.append(here)
                ids.append(sorted(items - {None}))
            arrays = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(ids, pa.list_(pa.string()))]
            yield _with_columns(batch, dict(zip(names, arrays, strict=True)), schema.names)

    return docs.mapInArrow(match, schema)


def _in_passes(docs: DataFrame, blocks: Iterator[list], window: int, found: T.StructType) -> DataFrame:
    """The same by a pass for each block. Only rows that a block hits are written and joined."""
    n_words, spans, item_ids = found.names
    rows = save(docs.drop(*found.names).withColumn("__row", F.monotonically_increasing_id()), "decontam")
    hits = None
    for pieces in blocks:
        hit = _matched(rows.select("__row", "text"), pieces, window, found).filter(F.size(spans) > 0)
        hit = save(hit.select("__row", spans, item_ids), "hits")
        hits = hit if hits is None else hits.union(hit)
    # a row's hits are as many as its words at most, and its blocks
    each = hits.groupBy("__row").agg(F.flatten(F.collect_list(spans)).alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_list(item_ids)))).alias(item_ids))
    joined = rows.join(save(each, "hits"), "__row", "left").drop("__row")
    schema = with_fields(docs.schema, *found.fields)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = [len(words_of(t or b"")) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            merged = [_merged([tuple(s) for s in of or ()]) for of in batch.column(spans).to_pylist()]
            ids = [x or [] for x in batch.column(item_ids).to_pylist()]
            arrays = [pa.array(counts, pa.int64()), pa.array(merged, pa.list_(pa.list_(pa.int32()))), pa.array(ids, pa.list_(pa.string()))]
            yield _with_columns(batch, dict(zip(found.names, arrays, strict=True)), schema.names)

    return joined.mapInArrow(merge, schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


#: The same in DuckDB: windows of the items met with the documents' windows of the same lengths.
OP2_SQL = r"""
WITH item AS (
  SELECT DISTINCT item_id::VARCHAR AS item_id, w, len(w) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
  ) WHERE len(w) > 0
), windows AS (
  SELECT item_id, least(n, 10) AS size, array_to_string(w[pos : pos + least(n, 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, greatest(n - 9, 1) + 1)) AS pos FROM item)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), own AS (
  SELECT r, size, pos, array_to_string(w[pos : pos + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM doc, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS (
  SELECT r, pos, own.size, item_id FROM own JOIN windows ON own.size = windows.size AND own.win = windows.win
), words AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(pos, pos + size)) AS p FROM (SELECT DISTINCT r, pos, size FROM hits)) GROUP BY r
), ids AS (
  SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN ids USING (r)
"""
