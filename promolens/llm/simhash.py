"""SimHash near-duplicates with pigeonring filtering of candidates.

A fingerprint has 64 bits in SEGMENTS consecutive segments around a ring. If two differ in at
most `limit` bits, then somewhere on the ring a chain of segments starts whose first l segments
together differ in at most l x limit / SEGMENTS bits, for every l. With 4 bits and 5 segments
the first segment of that chain is equal and the first two differ in at most one bit. So rows
are dealt by the first two segments of each of the five chains; since two values one bit apart
have different parity, only those of even parity are also dealt under their one-bit variants. Within
a key, pairs that break the budgets of three and four segments are dropped before the
full Hamming check.

Equal fingerprints meet first and count as one, so copies cost nothing here. A key's
fingerprints are never expanded into all pairs: each task walks sorted keys and writes only the
links of a spanning forest of each key, found by breadth-first search, which compares each
fingerprint with those only that aren't reached yet; many near copies under one key are soon all
reached. Components come from those links by hooking to the smallest neighbour and shortcutting,
each round written to the shared folder. Whatever a large component's nodes are joined with is a
written table, so that Spark can split them over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.llm.common import save, ship_by_value, slices, table, with_fields

ship_by_value(__name__)

SHINGLE, LIMIT, SEGMENTS = 4, 4, 5
CUTS = [64 * i // SEGMENTS for i in range(SEGMENTS + 1)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 (seed 42) of the word shingles; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    part: list[int] = []
    for a, b in spans:
        part.append(digest(flat[a:b], 42))
        if len(part) == 4096:
            total += _bit_counts(part)
            part = []
    if part:
        total += _bit_counts(part)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def _bit_counts(values: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(values, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, name: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with the fingerprint as a long; null texts count as empty."""
    kept = keep or docs.columns
    field = T.StructField(name, T.LongType())
    schema = with_fields(docs.select(*kept).schema, field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            seen: dict[bytes, int] = {}
            prints = [seen[t] if t in seen else seen.setdefault(t, fingerprint(t, shingle)) for t in (t or b"" for t in texts)]
            made = pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([made if f.name == name else batch.column(f.name) for f in schema], [f.name for f in schema])

    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)


def _segment(fps: np.ndarray, i: int) -> np.ndarray:
    a, b = CUTS[i], CUTS[i + 1]
    return (fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp, variant) for each chain start: the exact first two segments, and for even parity of
    the second one each of its one-bit variants."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(SEGMENTS):
            j = (i + 1) % SEGMENTS
            first, second = _segment(fps, i), _segment(fps, j)
            width = CUTS[j + 1] - CUTS[j]
            head = (np.uint64(i) << np.uint64(32)) | (first << np.uint64(16))
            even = np.bitwise_count(second) % 2 == 0
            keys, rows = [head | second], [fps]
            for bit in range(width):
                keys.append(head[even] | (second[even] ^ np.uint64(1 << bit)))
                rows.append(fps[even])
            variant = np.concatenate([np.zeros(len(fps), bool), np.ones(len(fps[even]) * width, bool)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(rows).view(np.int64)), pa.array(variant)],
                ["key", "fp", "variant"],
            )


def _masks(start: int, limit: int) -> list[tuple[np.uint64, int]]:
    """(bits, budget) of the chains of three segments and more from segment `start`; the longest is the whole ring."""
    out = []
    for size in range(3, SEGMENTS + 1):
        mask = 0
        for k in range(size):
            i = (start + k) % SEGMENTS
            mask |= ((1 << (CUTS[i + 1] - CUTS[i])) - 1) << CUTS[i]
        out.append((np.uint64(mask), size * limit // SEGMENTS))
    return out


def _near(diff: np.ndarray, masks: list[tuple[np.uint64, int]]) -> np.ndarray:
    """Positions of the differences that keep every chain's budget; each test sees only what the last one left."""
    at = np.arange(len(diff))
    for mask, budget in masks:
        at = at[np.bitwise_count(diff[at] & mask) <= budget]
    return at


def _forest(fps: np.ndarray, n_exact: int, masks: list[tuple[np.uint64, int]]) -> list[tuple[int, int]]:
    """Links of a spanning forest of one key's fingerprints, of which the first n_exact are exact.

    Pairs of variants lie two bits apart in the second segment and are found elsewhere.
    """
    left, links, queue = np.arange(len(fps)), [], []
    while queue or (len(left) and left[0] < n_exact):
        if queue:
            r = queue.pop()
        else:
            r, left = left[0], left[1:]
        among = left if r < n_exact else left[: np.searchsorted(left, n_exact)]
        near = among[_near(fps[among] ^ fps[r], masks)]
        if len(near):
            links += zip(np.repeat(fps[r], len(near)), fps[near], strict=True)
            queue += near.tolist()
            left = left[~np.isin(left, near, assume_unique=True)]
    return links


def _linked(limit: int):
    """Walks rows (key, fp, variant) sorted by key; a key may span batches."""
    chains = [_masks(i, limit) for i in range(SEGMENTS)]

    def walk(key: np.ndarray, fp: np.ndarray, variant: np.ndarray) -> list[tuple[int, int]]:
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        sizes, exact = np.diff(edges), np.add.reduceat(~variant, edges[:-1])
        links = []
        two = edges[:-1][(sizes == 2) & (exact > 0)]
        for i, masks in enumerate(chains):  # most keys hold two: all at once
            at = two[(key[two] >> 32) == i]
            at = at[_near(fp[at] ^ fp[at + 1], masks)]
            links += zip(fp[at], fp[at + 1], strict=True)
        for a, n, e in zip(edges[:-1], sizes, exact, strict=True) if (sizes > 2).any() else ():
            if n > 2 and e:
                own, v = fp[a : a + n], variant[a : a + n]
                links += _forest(np.concatenate([own[~v], own[v]]), int(e), chains[int(key[a]) >> 32])
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            held.append((key, fp.view(np.uint64), np.asarray(batch.column(2).to_pylist(), bool)))
            if key[0] == key[-1] and held[0][0][0] == key[0]:
                continue  # the open key goes on
            key, fp, variant = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            held = [(key[cut:], fp[cut:], variant[cut:])]
            yield _edges(walk(key[:cut], fp[:cut], variant[:cut]))
        if held:
            yield _edges(walk(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return run


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most `limit` (4 or fewer) bits apart, enough to connect
    whatever all such links connect."""
    if not 0 <= limit <= LIMIT:
        raise ValueError(f"the chains hold for at most {LIMIT} bits")
    keyed = prints.select("fp").mapInArrow(_keyed, "key long, fp long, variant boolean")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_linked(limit), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Alternates the large-star and small-star steps until nothing changes; each round is written.
    """
    edges = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    last = None
    while True:
        sign = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == last or not sign[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct()
            )
        last = sign
        both = edges.union(edges.select("v", "u"))
        least = save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = save(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "large")
        least = save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m")))
        edges = save(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")


def _components_of(nodes: DataFrame, limit: int) -> DataFrame:
    """(fp, first) of nodes (fp, least): the smallest `least` among the fingerprints that links reach."""
    roots = components(links(nodes, limit))
    linked = save(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "linked")
    firsts = save(linked.groupBy("root").agg(F.min("least").alias("first")), "firsts")
    return linked.join(firsts, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (long), component_id: the smallest doc_id that links reach.

    Null texts count as empty, and empty texts share fingerprint 0. Rows with a null id get the
    smallest id of their component, null if there is none. Repeated rows each get a row. Other columns
    are left out. An empty table gives no rows.
    """
    prints = save(with_fingerprint(docs, shingle, "fp", keep=["doc_id"]), "prints")
    nodes = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    named = save(_components_of(nodes, limit), "named")
    return prints.join(named, "fp").select("doc_id", F.col("fp").alias("fingerprint"), F.col("first").alias("component_id"))


def _keyed_rows(docs: DataFrame) -> DataFrame:
    """docs with (__id, __text): equal for rows of equal id (null: the least long) and equal text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__text": F.xxhash64(F.col("doc_id").isNull(), text)})


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, rows without an id last.

    Rows that repeat an id are told apart by their texts; of rows equal in both the one stays whose
    other columns hash lowest. Null texts count as empty. Columns keep their names, order and values;
    an empty table gives no rows.
    """
    keyed = _keyed_rows(docs)
    prints = save(with_fingerprint(keyed, shingle, "fp", keep=["doc_id", "__id", "__text"]), "prints")
    rows = prints.groupBy("fp", F.col("doc_id").isNull().alias("none"), "__id", "__text").agg(F.count("*").alias("rows"))
    nodes = save(rows.groupBy("fp").agg(F.min(F.struct("none", "__id", "__text", "rows")).alias("least")), "nodes")
    kept = save(_components_of(nodes, limit).select("first.*").distinct(), "kept")
    single = keyed.join(kept.filter("rows = 1"), ["__id", "__text"], "left_semi").select(*docs.columns)
    several = kept.filter("rows > 1")
    if several.isEmpty():
        return single
    equal = keyed.join(several, ["__id", "__text"], "left_semi")
    order = F.xxhash64(*[F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    one = equal.groupBy("__id", "__text").agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return single.union(one.select("row.*"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
