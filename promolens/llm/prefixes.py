"""Prefix trie of conversations, built as burst tries.

A conversation becomes one row of fixed-width turn digests. Trie heads are the prefixes that too many conversations
share; every other conversation hangs below the deepest head of its prefixes, in the container of those
with the same next turn. Containers burst window by window: the prefixes of the next depths are counted, those over
the limit become heads, and only conversations that still lie under a head at the window's end go on. The
limit grows with the table, so that a depth never has more than `HEADS` heads. Containers that remain hold at most
`limit` conversations; they are dealt out by their prefix, sorted and swept into nodes, each in one pass with a stack.
Sums of whole subtrees then go from containers to heads and up the heads.

Nothing but heads leaves the executors. Ids of conversations that end at a head are read in order as a stream, so a
third of the table may end at one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.common import save, ship_by_value, table, text_or_empty

ship_by_value(__name__)

LIMIT, HEADS, WINDOW = 256, 1 << 16, 16
ROOT = bytes(16)
WORD = r"[^\x20\x09-\x0D]+"

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of the turn; the role's length stands before it, so that its end is known."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, base, turns): the turns (id, words) of each conversation in order, `base` being conv_id - conv_id % 20.

    Turns are ordered by turn, null first; ties by role and digest. Null roles and texts count as empty. Rows without a
    conv_id belong to no conversation. One row holds 24 bytes a turn, whatever the texts' lengths.
    """
    role, text = text_or_empty("role"), text_or_empty()
    id_ = F.col("conv_id").cast("long")
    rows = conversations.filter(id_.isNotNull()).select(
        (id_ - id_ % 20).alias("base"), id_.alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), turn_digest(role, text).alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    # dealt by base, so that conversations meet the one that they start with where they are
    each = rows.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "id", "words"))).alias("t"))
    return each.select("conv_id", "base", F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("turns"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Each conversation with the first h turns of its base in place of its own first h, h = crc32(conv_id) % 4."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    firsts = seqs.filter("conv_id = base").select("base", F.slice("turns", 1, 3).alias("firsts"))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    lead = F.coalesce(F.slice("firsts", F.lit(1), h), F.slice("turns", 1, 0))
    return seqs.join(firsts, "base", "left").select("conv_id", F.concat(lead, rest).alias("turns"))


def _step(key: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(key + turn, digest_size=16).digest()


def _paths(turns: pa.Array, limit: int | None = None) -> Iterator[list[bytes]]:
    """Keys of the prefixes of each row, shortest first, without the root's."""
    for row in turns:
        key, keys = ROOT, []
        for t in row.values.field(0)[:limit].to_pylist() if len(row.values) else ():
            key = _step(key, t)
            keys.append(key)
        yield keys


def _heads(seqs: DataFrame, limit: int, window: int) -> dict[bytes, tuple[int, int, int]]:
    """key: (depth, conversations, smallest id) of the prefixes that more than `limit` conversations share.

    At most HEADS of each depth, since their conversations differ.
    """
    sc = seqs.sparkSession.sparkContext
    heads: dict[bytes, tuple[int, int, int]] = {}
    at, active = 0, {ROOT}
    while active:
        known = sc.broadcast(active)

        def count(batches: Iterator[pa.RecordBatch], at: int = at, known=known) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[bytes, int], list[int]] = {}

            def flush() -> pa.RecordBatch:
                made = pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in found], pa.binary()), pa.array([d for _, d in found], pa.int64()), *(pa.array([v[i] for v in found.values()], pa.int64()) for i in (0, 1))], ["key", "depth", "n", "conv_id"]
                )
                found.clear()
                return made

            for batch in batches:
                for conv, keys in zip(batch.column("conv_id").to_pylist(), _paths(batch.column("turns"), at + window), strict=True):
                    if len(keys) > at and (keys[at - 1] if at else ROOT) in known.value:
                        for d, key in enumerate(keys[at:], at + 1):
                            v = found.setdefault((key, d), [0, conv])
                            v[0] += 1
                            v[1] = min(v[1], conv)
                if len(found) > 200_000:
                    yield flush()
            yield flush()

        counts = seqs.filter(F.size("turns") > at).mapInArrow(count, "key binary, depth long, n long, conv_id long")
        new = counts.groupBy("key", "depth").agg(F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")).filter(F.col("n") > limit).collect()
        heads |= {bytes(r["key"]): (r["depth"], r["n"], r["conv_id"]) for r in new}
        at += window
        active = {bytes(r["key"]) for r in new if r["depth"] == at}
        known.unpersist()
    return heads


def _hang(seqs: DataFrame, heads: dict[bytes, int]) -> DataFrame:
    """(head, parent, container, depth, conv_id, ids, words): each conversation below its deepest head, with the turns
    from there on; no container where it ends at the head. `parent` is the smallest id below the head."""
    shared = seqs.sparkSession.sparkContext.broadcast(heads)
    schema = "head binary, parent long, container binary, depth long, conv_id long, ids array<binary>, words array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = shared.value
        for batch in batches:
            rows = []
            for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns"), strict=True):
                ids, words = (turns.values.field(i).to_pylist() if len(turns.values) else [] for i in (0, 1))
                head, key, depth = ROOT, None, 0
                for t in ids:
                    key = _step(head, t)
                    if key not in heads:
                        break
                    head, key, depth = key, None, depth + 1
                rows.append((head, heads[head], key, depth, conv, ids[depth:], words[depth:]))
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["head", "parent", "container", "depth", "conv_id", "ids", "words"])

    return seqs.mapInArrow(run, schema)


def swept(rows: list[tuple[int, list, list]], depth: int, parent: int) -> list[tuple]:
    """Nodes of a container's conversations (id, turn ids, words), sorted by turn ids; the container's own node first.

    A conversation shares the nodes of the one before it as far as their turns agree.
    """
    up, low, deep, words, kids, leaves, saved, n, ends = [], [], [], [], [], [], [], [], []
    before, path = [], []
    for conv, ids, counts in rows:
        same = 0
        while same < min(len(before), len(ids)) and before[same] == ids[same]:
            same += 1
        del path[same:]
        for d in range(same, len(ids)):
            up.append(path[-1] if path else -1)
            path.append(len(low))
            low.append(conv)
            deep.append(depth + d + 1)
            words.append(counts[d])
            kids.append(0)
            leaves.append(0)
            saved.append(0)
            n.append(0)
            ends.append([])
        ends[path[-1]].append(conv)
        before = ids
    for i in range(len(low) - 1, -1, -1):  # children stand after their parents
        n[i] += len(ends[i])
        low[i] = min(low[i], *ends[i]) if ends[i] else low[i]
        leaves[i] += not kids[i]
        saved[i] += (n[i] - 1) * words[i]
        if (p := up[i]) >= 0:
            n[p] += n[i]
            kids[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
            low[p] = min(low[p], low[i])
    listed = [hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest() for e in ends]
    return [(low[i], deep[i], low[up[i]] if up[i] >= 0 else parent, n[i], kids[i], leaves[i], saved[i], listed[i]) for i in range(len(low))]


_KINDS = (*[pa.int64()] * 7, pa.string())


def _sweep(hung: DataFrame) -> DataFrame:
    """Nodes below heads; `head` is set in a container's own node."""
    names = [f.split()[0] for f in NODE.split(", ")]

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate((*_KINDS, pa.binary()))], [*names, "head"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("container", "head", "depth", "parent", "conv_id", "ids", "words")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, rows in groupby(stream(batches), itemgetter(0)):
            held = list(rows)
            _, head, depth, parent, *_ = held[0]
            nodes = swept([r[4:] for r in held], depth, parent)
            out.append((*nodes[0], head))
            out.extend((*x, None) for x in nodes[1:])
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    dealt = hung.filter(F.col("container").isNotNull()).repartition("container").sortWithinPartitions("container", "ids", "conv_id")
    return dealt.mapInArrow(run, f"{NODE}, head binary")


def _ends(hung: DataFrame) -> DataFrame:
    """(head, n, ends_sha256) of the conversations that end at heads, hashed in order as they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, n, text = None, 0, hashlib.sha256()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([head], pa.binary()), pa.array([n], pa.int64()), pa.array([text.hexdigest()])], ["head", "n", "ends_sha256"])

        for b in batches:
            for key, conv in zip(b.column("head").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if key != head:
                    if n:
                        yield done()
                    head, n, text = key, 0, hashlib.sha256()
                text.update(f"{',' if n else ''}{conv}".encode())
                n += 1
        if n:
            yield done()

    at_heads = hung.filter(F.col("container").isNull()).select("head", "conv_id").repartition("head").sortWithinPartitions("head", "conv_id")
    return at_heads.mapInArrow(run, "head binary, n long, ends_sha256 string")


def prefix_trie(seqs: DataFrame, limit: int = LIMIT, window: int = WINDOW) -> DataFrame:
    """One row for each node of the trie of (conv_id, turns), the root included; see NODE.

    conv_id must be unique and not null, as in sequences(). Conversations without turns end at the root. An empty
    table gives no rows. A conversation is one row of 24 bytes a turn, so it must fit a task; copies of one, and
    conversations with a prefix in common, may be as many as they like.
    """
    spark = seqs.sparkSession
    seqs = save(seqs, "conversation-turns")
    total, least = seqs.agg(F.count("*"), F.min("conv_id")).first()
    limit = max(limit, total // HEADS)
    heads = _heads(seqs, limit, window)
    hung = save(_hang(seqs, {ROOT: least, **{k: v[2] for k, v in heads.items()}}), "conversation-suffixes")
    below = save(_sweep(hung), "conversation-nodes")

    # heads with their paths, read back from the smallest conversation of each
    rows = [(bytearray(k), *v) for k, v in heads.items()]
    listed = spark.createDataFrame(rows, "key binary, depth long, n_convs long, conv_id long")

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for depth, keys in zip(b.column("depth").to_pylist(), _paths(b.column("turns")), strict=True):
                made.append([ROOT, *keys[:depth]])
            words = [t.values.field(1)[d - 1].as_py() for d, t in zip(b.column("depth").to_pylist(), b.column("turns"), strict=True)]
            rest = b.drop_columns(["turns"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(words, pa.int64()), pa.array(made, pa.list_(pa.binary()))], [*rest.schema.names, "words", "path"])

    held = "key binary, depth long, n_convs long, conv_id long"
    upper = listed.join(seqs, "conv_id").select("key", "depth", "n_convs", "conv_id", "turns").mapInArrow(paths, f"{held}, words long, path array<binary>")
    root = seqs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    root = root.select(F.lit(bytearray(ROOT)).alias("key"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv_id", F.lit(0).cast("long").alias("words"), F.array(F.lit(bytearray(ROOT))).alias("path"))
    upper = save(upper.unionByName(root), "conversation-heads")
    parents = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parent = F.get("path", F.size("path") - 2)

    boxes = below.filter(F.col("head").isNotNull()).groupBy(F.col("head").alias("key")).agg(F.count("*").alias("boxes"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    children = upper.filter("depth > 0").groupBy(parent.alias("key")).agg(F.count("*").alias("kids"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    own = upper.join(boxes, "key", "left").join(children, "key", "left").join(_ends(hung).select(F.col("head").alias("key"), "ends_sha256"), "key", "left")
    own = own.na.fill(0).withColumn("n_children", F.col("boxes") + F.col("kids"))
    own = own.withColumn("leaves", F.col("leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("words"))
    own = save(own.select("key", "depth", "n_convs", "conv_id", "path", "n_children", "leaves", "saved", F.coalesce("ends_sha256", none).alias("ends_sha256")), "conversation-own")
    sums = own.select(F.explode("path").alias("key"), "leaves", "saved").groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    top = own.withColumn("parent", parent).join(sums, "key").join(parents, "parent", "left")
    names = [f.split()[0] for f in NODE.split(", ")]
    return top.select(*names).unionByName(below.select(*names))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))


#: The same in DuckDB: nodes are groups of equal prefixes; a node adds its figures to each of its own prefixes.
OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), seqs AS MATERIALIZED (
  SELECT conv_id, list({'t': len(role) || ':' || role || text, 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))}
                       ORDER BY turn NULLS FIRST, role, sha256(len(role) || ':' || role || text)) AS s
  FROM turns GROUP BY conv_id
), coded AS (
  SELECT conv_id, s,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, e: xor(xor(a, e) >> 1, CASE WHEN xor(a, e) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295::BIGINT) % 4 AS h
  FROM seqs
), built AS MATERIALIZED (
  SELECT c.conv_id, coalesce(b.s[1 : c.h], []) || c.s[c.h + 1 :] AS s FROM coded c LEFT JOIN seqs b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS MATERIALIZED (
  SELECT conv_id, d AS depth, sha256(array_to_string(list_transform(s[1 : d], lambda x: sha256(x.t)), ',')) AS key,
         CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS words, d = len(s) AS ends
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built)
), nodes AS MATERIALIZED (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n, min(words) AS words,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS listed
  FROM prefixes GROUP BY depth, key
), linked AS MATERIALIZED (
  SELECT n.*, up.key AS parent FROM nodes n LEFT JOIN prefixes up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1
), children AS MATERIALIZED (SELECT depth - 1 AS depth, parent AS key, count(*) AS kids FROM linked WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT p.depth, p.key, sum(CASE WHEN k.kids IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n.n - 1) * n.words) AS saved
  FROM nodes n LEFT JOIN children k ON k.depth = n.depth AND k.key = n.key
  JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY ALL
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.kids, 0)::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.listed) AS ends_sha256
FROM linked n LEFT JOIN children k ON k.depth = n.depth AND k.key = n.key
JOIN sums s ON s.depth = n.depth AND s.key = n.key
LEFT JOIN nodes up ON up.depth = n.depth - 1 AND up.key = n.parent
"""
