"""Source divergence audit: how far the word use of each source lies from the others of its language.

Terms are counted under 64-bit digests: a task adds up its own documents by (language, source) and only
then hashes each distinct term, so what is shuffled has a fixed width but for the names of languages
and sources. Terms in too few documents go. For the kept digests a second pass brings the smallest and the
largest term of each; where they differ several terms share the digest, and a third pass counts these by their
text. Distances between sources are added up from slices of the terms, in blocks of sources, so that no
task holds a whole language; the text of a term is joined only to rows that are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from promolens.llm.common import save, ship_by_value, share, shared_arrays, small_batches, table, text_or_empty

ship_by_value(__name__)

#: Bytes to bytes: A-Z lower-cased; ASCII other than letters becomes a space.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
MIN_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
HELD = 400_000  # terms of a group that a task holds before it passes counts on
PIECE = 4 << 20  # bytes of a text that are split at once
PIECE_BITS = 1 << 20  # of a bitmap, set in one task
SLICE = 100_000  # counts that one task of the distances takes, about
BLOCK = 256  # sources that one task of the distances takes, about


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    at = 0
    while at < len(text):
        end = at + PIECE
        flat = text[at:end].translate(LETTERS)
        if end < len(text) and not flat.endswith(b" "):
            cut = flat.rfind(b" ") + 1
            while not cut and end < len(text):  # a term longer than a piece
                end += PIECE
                flat = text[at:end].translate(LETTERS)
                cut = flat.rfind(b" ") + 1 if end < len(text) else len(flat)
            flat = flat[:cut] if end < len(text) else flat
        yield flat.split()
        at += len(flat)


def digest(term: bytes, bits: int = 64) -> int:
    """A signed number of the term's highest `bits` digest bits."""
    return (xxhash.xxh64_intdigest(term) >> (64 - bits)) - (1 << 63 if bits == 64 else 0)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, str], bytes]]:
    langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
    return zip(zip(langs, sources, strict=True), batch.column("text").cast(pa.binary()), strict=True)


def _count_terms(key: Callable[[bytes], object], kind: pa.DataType, wanted: Callable[[bytes], bool] | None = None):
    """mapInArrow function: (lang, source, key(term), n, docs) of the terms, added up within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        words: dict[tuple[str, str], Counter] = {}
        docs: dict[tuple[str, str], Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for group, n in words.items():
                held = docs[group]
                names = [t for t in n if wanted is None or wanted(t)]
                for at in range(0, len(names), 50_000):
                    some = names[at : at + 50_000]
                    made = pa.array([key(t) for t in some], kind)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([group[0]] * len(some)), pa.array([group[1]] * len(some)), made, pa.array([n[t] for t in some], pa.int64()), pa.array([held[t] for t in some], pa.int64())],
                        ["lang", "source", "key", "n", "docs"],
                    )
            words.clear()
            docs.clear()

        for batch in batches:
            for group, text in _groups(batch):
                n, own = words.setdefault(group, Counter()), set()
                for piece in terms_of(text.as_py()):
                    n.update(piece)
                    own.update(piece)
                docs.setdefault(group, Counter()).update(own)
            if sum(map(len, words.values())) > HELD:
                yield from flush()
        yield from flush()

    return run


class Few:
    """A set of digests as a bitmap: some others pass too, none of the set is missed."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __contains__(self, d: int) -> bool:
        bitmap = shared_arrays(self.path)[0]
        at = d & (len(bitmap) * 8 - 1)
        return bool(bitmap[at >> 3] >> (at & 7) & 1)


def _bitmap(digests: DataFrame, n: int) -> Few:
    """A bitmap of 16 bits and more a digest, 2^30 bits at most; beyond some 2^27 digests it lets more others through."""
    bits = 1 << (min(max(16 * n, 1 << 13), 1 << 30) - 1).bit_length()
    size = min(bits, PIECE_BITS)

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(size, np.uint8)
        on[rows["at"].to_numpy() % size] = 1
        return pd.DataFrame({"piece": [int(rows["at"].iloc[0]) // size], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    at = digests.select(F.col("digest").bitwiseAND(F.lit(bits - 1)).alias("at")).distinct()
    made = np.zeros(bits // 8, np.uint8)
    for piece, packed in at.groupBy(F.floor(F.col("at") / size)).applyInPandas(fill, "piece long, bits binary").toLocalIterator():
        made[piece * size // 8 : (piece + 1) * size // 8] = np.frombuffer(packed, np.uint8)
    return Few(share(digests.sparkSession, "kept-digests", [made]))


def _clean(docs: DataFrame) -> DataFrame:
    return docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), text_or_empty().alias("text"))


def _kept(rows: DataFrame, key: str, min_docs: int) -> DataFrame:
    """Counts by (lang, source, key) of keys in enough documents of the language, with lang_n; one shuffle for both."""
    one = Window.partitionBy("lang", key)
    sums = rows.repartition("lang", key).groupBy("lang", "source", key).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    sums = sums.select("lang", "source", key, "n", F.sum("docs").over(one).alias("in_docs"), F.sum("n").over(one).alias("lang_n"), (F.col("source") == F.min("source").over(one)).alias("first"))
    return sums.filter(F.col("in_docs") >= min_docs).drop("in_docs")


def cells(docs: DataFrame, min_docs: int = MIN_DOCS, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, source, digest, split, n, lang_n, first) of the kept terms, and their texts (lang, digest,
    split, item). `split` is empty but for terms that share a digest, where it is the term itself."""
    text = _clean(docs)
    with small_batches(docs.sparkSession, 512):
        rows = text.mapInArrow(_count_terms(lambda t: digest(t, bits), pa.int64()), "lang string, source string, key long, n long, docs long")
        counted = save(_kept(rows.withColumnRenamed("key", "digest"), "digest", min_docs), "divergence-counts")
        of_lang = counted.filter("first").select("lang", "digest")
        few = _bitmap(of_lang, of_lang.count())

        def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The smallest and the largest term of each digest that may be kept, by language."""
            seen: dict[str, set[bytes]] = {}

            def flush() -> Iterator[pa.RecordBatch]:
                for lang, terms in seen.items():
                    found: dict[int, tuple[bytes, bytes]] = {}
                    for t in terms:
                        d = digest(t, bits)
                        if d in few:
                            lo, hi = found.get(d, (t, t))
                            found[d] = (min(lo, t), max(hi, t))
                    made = list(found.items())
                    for at in range(0, len(made), 50_000):
                        some = made[at : at + 50_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(some)), pa.array([d for d, _ in some], pa.int64()), *(pa.array([x[i] for _, x in some], pa.binary()).cast(pa.string()) for i in (0, 1))], ["lang", "digest", "lo", "hi"]
                        )
                seen.clear()

            for batch in batches:
                for (lang, _), text in _groups(batch):
                    for piece in terms_of(text.as_py()):
                        seen.setdefault(lang, set()).update(piece)
                if sum(map(len, seen.values())) > HELD:
                    yield from flush()
            yield from flush()

        found = text.mapInArrow(edges, "lang string, digest long, lo string, hi string").groupBy("lang", "digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        found = save(found.join(of_lang, ["lang", "digest"]), "divergence-terms")
        shared = found.filter(F.col("lo") != F.col("hi")).select("lang", "digest")
        plain = counted.withColumn("split", F.lit(""))
        names = found.filter(F.col("lo") == F.col("hi")).select("lang", "digest", F.lit("").alias("split"), F.col("lo").alias("item"))
        if n := shared.count():
            some = _bitmap(shared, n)
            rows = text.mapInArrow(_count_terms(lambda t: t.decode(), pa.string(), lambda t: digest(t, bits) in some), "lang string, source string, key string, n long, docs long")
            exact = _kept(rows.withColumnRenamed("key", "split"), "split", min_docs)
            of = _digests(exact.select("lang", "split").distinct(), bits)
            of = save(of.join(shared, ["lang", "digest"], "left_semi"), "divergence-split")
            exact = save(exact.join(of, ["lang", "split"]), "divergence-exact")
            plain = plain.join(shared, ["lang", "digest"], "left_anti").unionByName(exact)
            names = names.unionByName(of.select("lang", "digest", "split", F.col("split").alias("item")))
    return plain, names


def _digests(df: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("digest", pa.array([digest(t.encode(), bits) for t in b.column("split").to_pylist()], pa.int64()))

    return df.mapInArrow(run, "lang string, split string, digest long")


def probability(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), exact."""
    exact = lambda c: c.cast("decimal(20,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * exact(count + SMOOTHING)
    return F.when(kept > 0, F.lit(1) + F.call_function("div", above, exact(total + SMOOTHING * kept)))


def _slice_distances(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over the terms of one slice, for each two sources of one pair of blocks."""
    names, source = np.unique(rows["source"].to_numpy(object), return_inverse=True)
    block = np.zeros(len(names), np.int64)
    block[source] = rows["block"].to_numpy()
    base = np.zeros(len(names), np.int64)
    bare = rows["n"].to_numpy() == 0  # a source's own row, with the value of a term that it lacks
    base[source[bare]] = rows["p"].to_numpy()[bare]
    some = rows[~bare]
    term = pd.MultiIndex.from_arrays([some["digest"], some["split"]]).factorize()[0] if len(some) else np.zeros(0, np.int64)
    order = np.argsort(term, kind="stable")
    term, of, p = term[order], source[~bare][order], some["p"].to_numpy()[order]
    seen = int(term[-1]) + 1 if len(term) else 0
    sums = np.zeros((len(names), len(names)), np.int64)
    step = max(1, 2_000_000 // max(len(names), 1))
    for at in range(0, seen, step):
        a, b = np.searchsorted(term, [at, at + step])
        dense = np.repeat(base[:, None], min(step, seen - at), axis=1)
        dense[of[a:b], term[a:b] - at] = p[a:b]
        for i in range(len(names) - 1):
            sums[i, i + 1 :] += np.abs(dense[i + 1 :] - dense[i]).sum(axis=1)
    i, j = np.triu_indices(len(names), 1)
    lo, hi = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
    # a pair within one block comes out of that block alone
    own = (block[i] != block[j]) if lo != hi else np.full(len(i), True)
    i, j = i[own], j[own]
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "a": names[i], "b": names[j], "value": sums[i, j], "seen": seen, "a0": base[i], "b0": base[j]})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bits: int = 64, slice_rows: int = SLICE, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has the distance to each other source of the language,
    part `term` the `top` terms whose share in the source exceeds that in the language by most.

    Null texts, languages and sources count as empty ones; ids are never looked at, so every row counts, repeated
    ones too; other columns are ignored. A source without kept terms is at its distances all the same; a
    language without kept terms has distances of 0 and no terms. Ties rank by the item's bytes. An empty table
    gives no rows.
    """
    counts, names = cells(docs, min_docs, bits)
    here = _clean(docs).select("lang", "source").distinct()
    per = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("first").alias("kept"), F.sum(F.when(F.col("first"), F.col("lang_n"))).alias("lang_total"), F.count("*").alias("rows"))
    per = here.join(per, ["lang", "source"], "left").na.fill(0)
    lang = per.groupBy("lang").agg(F.sum("kept").alias("kept"), F.sum("lang_total").alias("lang_total"), F.sum("rows").alias("rows"), F.count("*").alias("sources"))
    groups = save(per.select("lang", "source", "total").join(lang, "lang"), "divergence-groups")

    p = counts.join(groups, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total"), F.col("kept")))
    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    return _pairs(p, groups, slice_rows, block).unionByName(_terms(p.withColumn("value", F.col("p") - q), names, top))


def _pairs(cells: DataFrame, groups: DataFrame, slice_rows: int, block: int) -> DataFrame:
    slices = F.ceil(F.col("rows") / slice_rows)
    blocks = F.greatest(F.ceil(F.col("sources") / block), F.lit(1))
    own = F.pmod(F.xxhash64("source"), blocks).cast("int").alias("block")
    bare = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.greatest(slices - 1, F.lit(0)).cast("int"))))
    bare = bare.select("lang", "source", "slice", F.lit(0).cast("long").alias("digest"), F.lit("").alias("split"), F.lit(0).cast("long").alias("n"), F.coalesce(probability(F.lit(0), F.col("total"), F.col("kept")), F.lit(0)).alias("p"), own, blocks.cast("int").alias("blocks"))
    rows = cells.select("lang", "source", F.pmod(F.xxhash64("digest", "split"), slices).cast("int").alias("slice"), "digest", "split", "n", "p", own, blocks.cast("int").alias("blocks"))
    rows = rows.unionByName(bare).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("lang", "slice", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "source", "block", "digest", "split", "n", "p")
    parts = rows.groupBy("lang", "slice", "lo", "hi").applyInPandas(_slice_distances, "lang string, a string, b string, value long, seen long, a0 long, b0 long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("a0").alias("a0"), F.max("b0").alias("b0"))
    # terms that neither source's block has in any of its sources
    sums = sums.join(groups.select("lang", "kept").distinct(), "lang")
    value = F.col("value") + (F.col("kept") - F.col("seen")) * F.abs(F.col("a0") - F.col("b0"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), value.alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", rank)


def _terms(rows: DataFrame, names: DataFrame, top: int) -> DataFrame:
    group = Window.partitionBy("lang", "source")
    # equal values keep their place until the text decides
    first = rows.filter(F.col("value") > 0).select("lang", "source", "digest", "split", "value").withColumn("place", F.rank().over(group.orderBy(F.desc("value")))).filter(F.col("place") <= top)
    named = first.join(names, ["lang", "digest", "split"])
    ranked = named.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


#: The same in DuckDB.
OP11_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), words AS MATERIALIZED (
  SELECT lang, source, item, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS item FROM docs) GROUP BY ALL
), kept AS MATERIALIZED (
  SELECT lang, item, sum(n)::HUGEINT AS lang_n FROM words GROUP BY lang, item HAVING sum(docs) >= 30
), groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
counts AS MATERIALIZED (
  SELECT g.lang, g.source, k.item, coalesce(w.n, 0)::HUGEINT AS n, k.lang_n
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN words w ON w.lang = g.lang AND w.source = g.source AND w.item = k.item
), shares AS MATERIALIZED (
  SELECT lang, source, item, n,
         1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 5)) // (sum(lang_n) OVER g + 5 * count(*) OVER g) AS q
  FROM counts WINDOW g AS (PARTITION BY lang, source)
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.item = y.item AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.a = a.source AND s.b = b.source
  UNION ALL
  SELECT lang, source, 'term', item, (p - q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
