"""Personal data: fixed patterns, and identifiers found by the contexts that they share with known ones.

Fixed patterns find emails, IP addresses, payment cards and phone numbers. These are the seeds of a bootstrapping
extractor. A mention is a run of tokens with digits or an at sign; its lexical patterns are the two words before it,
and the word before it with the word after it. Patterns and the distinct identifiers in them form a
bipartite graph, scored in rounds: a pattern's confidence is the score of its identifiers over their number plus
one, an identifier's score is one for a seed and else the chance that at least one of its trusted patterns is
right. After the last round, mentions that are no seeds count as found where their score is high enough.

DataFrame functions only. Each text is read once; what is shuffled are 64-bit digests of contexts and
identifiers, each pair once, so copies of a document add nothing to a pattern's support.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.common import save, table, text_or_empty
from promolens.llm.secrets import _let, _with_spans

KINDS = ("email", "ip", "card", "phone", "context")
# Possessive quantifiers, and no start within a run that has failed: linear in the text, and the same matches. A
# match may start right where the last one ended (\G), even within a run.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)"
IP_VALID = rf"^{PART}\.{PART}\.{PART}\.{PART}$"
#: What ends a token, besides white space.
EDGES = r"\s:=|,;<>\x22'\[\]{}"
MENTION = rf"(?<![^{EDGES}])[^{EDGES}0-9@]*+[0-9@][^{EDGES}]*+(?:\x20[^{EDGES}0-9@]*+[0-9@][^{EDGES}]*+)*+"

ROUNDS, SUPPORT, TRUST = 3, 3.0, 0.75
REACH = 64  # characters of context that are looked at
NEAR = 128  # spans in a block that is passed over at once


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's check."""
    odd = F.transform(F.split(F.reverse(number), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(odd, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _valid_card(x: Column) -> Column:
    return _let(digits(x), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))


#: kind: pattern, what a match must meet besides
BASE: tuple[tuple[str, Callable[[Column], Column] | None], ...] = (
    (EMAIL, None),
    (IP, lambda x: x.rlike(IP_VALID)),
    (CARD, _valid_card),
    (PHONE, lambda x: F.length(digits(x)).between(9, 15)),
)


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def with_base(df: DataFrame, name: str) -> DataFrame:
    """df with an array of (start, kind, end) of the fixed patterns in __text, by start and kind, in code points."""
    parts = []
    for kind, (pattern, valid) in enumerate(BASE):
        df = _with_spans(df, f"__{kind}", pattern, kind)
        spans = F.col(f"__{kind}")
        parts.append(_plain(F.filter(spans, lambda x: valid(x["match"])) if valid else spans))  # noqa: B023
    return df.withColumn(name, F.array_sort(F.concat(*parts))).drop(*[f"__{k}" for k in range(len(BASE))])


def _blocks(spans: Column) -> Column:
    """Spans in blocks of bounded size, with the least start and the greatest end of each."""
    last = F.floor((F.size(spans) - 1) / NEAR).cast("int")
    cut = F.when(F.size(spans) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(spans, b * NEAR + 1, F.lit(NEAR)))).otherwise(F.array())
    return F.transform(cut, lambda b: F.struct(b[0]["start"].alias("lo"), F.array_max(F.transform(b, lambda x: x["end"])).alias("hi"), b.alias("spans")))


def _any(blocks: Column, start: Column, end: Column, test: Callable[[Column], Column]) -> Column:
    """Whether a span that meets [start, end) passes the test."""
    return F.exists(blocks, lambda b: (b["lo"] < end) & (b["hi"] > start) & F.exists(b["spans"], lambda x: (x["start"] < end) & (x["end"] > start) & test(x)))


def _words(text: Column, front: bool) -> Column:
    """The words of a context, with marks where it ends."""
    near = F.concat(F.lit("^ ^ "), F.substring(text, -REACH, REACH)) if not front else F.concat(F.substring(text, 1, REACH), F.lit(" $"))
    return F.filter(F.split(F.lower(near), r"\s+"), lambda w: w != "")


def with_mentions(df: DataFrame, name: str, base: str) -> DataFrame:
    """df with an array of (start, end, id, patterns, seed) of the mentions in __text that are base spans or touch none.

    A mention loses its outer punctuation; `id` and `patterns` are digests of the identifier and of its contexts.
    """

    def trimmed(x: Column) -> Column:
        lead = F.length(x["match"]) - F.length(F.regexp_replace(x["match"], r"^[^A-Za-z0-9+(@#]++", ""))
        rest = F.substring(x["match"], lead + 1, F.length(x["match"]))
        core = F.reverse(F.regexp_replace(F.reverse(rest), r"^[^A-Za-z0-9)]++", ""))
        return F.struct((x["start"] + lead).alias("start"), (x["start"] + lead + F.length(core)).alias("end"), core.alias("core"))

    def looks(x: Column) -> Column:
        """Enough of an identifier: six characters and three digits, or an at sign within."""
        return (F.length(x["core"]) >= 6) & ((F.length(digits(x["core"])) >= 3) | x["core"].rlike("[A-Za-z0-9]@[A-Za-z0-9]"))

    # the texts between mentions are the contexts
    df = _with_spans(df, "__found", MENTION, 0).withColumn("__between", F.split("__text", MENTION, -1))
    df = df.withColumn("__cut", F.transform(F.col("__found"), lambda x, i: F.struct(trimmed(x).alias("m"), F.get("__between", i).alias("before"), F.get("__between", i + 1).alias("after"))))
    df = df.withColumn("__near", _blocks(F.col(base)))

    def judged(x: Column) -> Column:
        m = x["m"]
        seed = _any(F.col("__near"), m["start"], m["end"], lambda b: (b["start"] == m["start"]) & (b["end"] == m["end"]))
        clash = _any(F.col("__near"), m["start"], m["end"], lambda b: F.lit(True))
        left, right = _words(x["before"], False), _words(x["after"], True)
        patterns = _let(F.slice(left, -2, 2), lambda w: F.array(F.xxhash64(F.lit("before"), F.array_join(w, " ")), F.xxhash64(F.lit("around"), F.element_at(w, -1), right[0])))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.xxhash64(F.lower(m["core"])).alias("id"), patterns.alias("patterns"), seed.alias("seed"), clash.alias("clash"), looks(m).alias("looks"))

    found = F.filter(F.transform("__cut", judged), lambda x: x["seed"] | (x["looks"] & ~x["clash"]))
    return df.withColumn(name, F.transform(found, lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "id", "patterns", "seed")]))).drop("__found", "__between", "__cut", "__near")


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, trust: float = TRUST) -> DataFrame:
    """(id, score) of identifiers that are no seeds and reach `trust`, from distinct edges (pattern, id, seed)."""
    # a pattern with fewer identifiers than `support` can never have that much of it
    wide = edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    edges = save(edges.join(wide, "pattern"), "personal-edges")
    scores = None
    for _ in range(rounds):
        known = edges.withColumn("score", F.col("seed").cast("double"))
        if scores is not None:
            known = edges.join(scores, "id", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        confident = known.groupBy("pattern", "n").agg(F.sum("score").alias("sum")).withColumn("confidence", F.col("sum") / (F.col("n") + 1))
        confident = save(confident.filter((F.col("sum") >= support) & (F.col("confidence") >= trust)).select("pattern", "confidence"), "personal-patterns")
        right = edges.filter(~F.col("seed")).join(confident, "pattern").groupBy("id").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        scores = save(right, "personal-scores")
    return scores.filter(F.col("score") >= trust)


def find(docs: DataFrame, with_text: bool = True, rounds: int = ROUNDS, support: float = SUPPORT, trust: float = TRUST) -> DataFrame:
    """docs with `found`: array of (start, kind, end) by start and kind, kind an index of KINDS; without the text if so wished.

    Null texts count as empty and find nothing; ids are never looked at, so null or repeated ids and repeated rows
    each keep their own result; a column named `found` is replaced. An empty table gives no rows. Contexts are cut to
    their nearest 64 characters, which tells very long words apart no further; texts are read whole.
    """
    kept = [c for c in docs.columns if c != "found" and (with_text or c != "text")]
    rows = with_mentions(with_base(docs.withColumn("__text", text_or_empty()), "__base"), "__mentions", "__base")
    # written with its row numbers: they hold, whatever is computed again
    rows = save(rows.select(*kept, "__base", "__mentions", F.monotonically_increasing_id().alias("__row")), "personal")
    each = rows.select("__row", F.explode("__mentions").alias("m"))
    edges = each.select(F.explode("m.patterns").alias("pattern"), F.col("m.id").alias("id"), F.col("m.seed").alias("seed"))
    # an identifier that is a seed anywhere is known
    edges = edges.groupBy("pattern", "id").agg(F.max("seed").alias("seed"))
    known = each.filter("m.seed").select(F.col("m.id").alias("id")).distinct().withColumn("known", F.lit(True))
    edges = edges.join(known, "id", "left").withColumn("seed", F.coalesce("known", F.lit(False))).drop("known")
    learned = bootstrap(edges, rounds, support, trust)
    hits = each.filter("NOT m.seed").select("__row", F.col("m.id").alias("id"), "m.start", F.lit(KINDS.index("context")).alias("kind"), "m.end").join(learned, "id", "left_semi")
    hits = save(hits.groupBy("__row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("__hits")), "personal-hits")
    out = rows.drop("__mentions").join(hits, "__row", "left")
    none = F.from_json(F.lit("[]"), "array<struct<start:bigint,kind:int,end:bigint>>")
    return out.select(*kept, F.array_sort(F.concat("__base", F.coalesce("__hits", none))).alias("found"))


def _listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    base = F.filter("found", lambda x: x["kind"] < 4)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return df.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
    )
