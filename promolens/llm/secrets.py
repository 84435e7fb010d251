"""Secret scan: fixed patterns plus a randomness test battery, with DataFrame functions only.

Patterns find assignments, access keys and hex digests. The battery takes every longer token
whose characters fit an encoding (hex, base32, base36, base64) and asks whether it looks drawn
at random from that alphabet: a chi-squared test of uniformity with the exact multinomial
variance, a runs test about the alphabet's middle and a lag-1 serial correlation test, combined
by Fisher's method. Under randomness the p-value is uniform, text piles up near 0; so within
each class of encoding and length the share of text among tokens with p >= t is estimated
(Storey), and the smallest t that holds it to `fdr` is that class's threshold. A class without
evidence of random tokens flags none. Everything is per row except one histogram of at most
16 x 101 counts, so no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.common import table, text_or_empty

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A match is a whole run of its class, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: name, alphabet, pattern of the whole token without padding
ENCODINGS = (
    ("hex", DIGITS + "abcdef", r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$"),
    ("base32", UPPER + "234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$"),
    ("base36", DIGITS + LOWER, r"^(?=.*[0-9])(?=.*[a-zA-Z])([0-9a-z]+|[0-9A-Z]+)$"),
    ("base64", UPPER + LOWER + DIGITS + "+/", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+$"),
)
LENGTHS = (32, 64, 128)  # bounds of the length classes
STEPS = 100  # of the p-value histogram


BLOCK = 128  # matches whose spans one fold gathers


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _with_spans(df: DataFrame, name: str, pattern: str, kind: int, least: int = 0) -> DataFrame:
    """df with an array of (start, kind, end, match) of the pattern in __text, in code points: the
    lengths of the pieces between matches and of the matches add up to the positions. With
    `least`, a match stays if its group 2 has so many characters.

    A fold copies its array for each element that it adds, so matches are gathered in blocks of a
    bounded number; a first fold over the blocks finds where each begins.
    """
    zero = F.lit(0).cast("long")

    def sized(x: Column) -> Column:
        keep = F.length(x["v"]) >= least if least else F.lit(True)
        return F.struct(F.length(x["p"]).cast("long").alias("gap"), F.length(x["h"]).cast("long").alias("size"), keep.alias("keep"), x["h"].alias("match"))

    def blocks(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))

    def begins(bs: Column) -> Column:
        first = F.struct(zero.alias("pos"), F.array().cast("array<bigint>").alias("at"))
        long = lambda b: F.aggregate(b, zero, lambda n, x: n + x["gap"] + x["size"])
        return F.aggregate(bs, first, lambda a, b: F.struct((a["pos"] + long(b)).alias("pos"), F.concat(a["at"], F.array(a["pos"])).alias("at")), lambda a: a["at"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"), x["match"].alias("match"))
        return F.struct((start + x["size"]).alias("pos"), F.when(x["keep"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def spans(b: Column, at: Column) -> Column:
        return F.aggregate(b, F.struct(at.alias("pos"), empty.alias("out")), step, lambda a: a["out"])

    hits = F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all("__text", F.lit(pattern), F.lit(2))
    empty = F.from_json(F.lit("[]"), "array<struct<start:bigint,kind:int,end:bigint,match:string>>")
    zipped = lambda p: _let(hits, lambda h: F.arrays_zip(F.slice(p, F.lit(1), F.size(h)).alias("p"), h.alias("h"), (values if least else h).alias("v")))
    found = lambda p: _let(F.transform(zipped(p), sized), lambda xs: _let(blocks(xs), lambda bs: F.flatten(F.zip_with(bs, begins(bs), spans))))
    return df.withColumn(name, _let(F.split("__text", pattern, -1), lambda p: F.when(F.size(p) > 1, found(p)).otherwise(empty)))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, Abramowitz and Stegun 26.2.17."""
    a = F.least(F.abs(z), F.lit(12.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    # fixed values of the published polynomial
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + F.lit(c)) * t
    tail = F.exp(-a * a / 2) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def judged(tokens: Column) -> Column:
    """array of (start, kind, end, cls, p) of the tokens that fit an encoding; cls = encoding x 4 + length class."""

    def encode(x: Column) -> Column:
        core = F.rtrim(F.translate(x["match"], "-_=", "+/ "))
        enc = F.lit(None).cast("int")
        for i, (_, _, pattern) in reversed(list(enumerate(ENCODINGS))):
            enc = F.when(x["match"].rlike(pattern.replace("$", "={0,2}$")), F.lit(i)).otherwise(enc)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), core.alias("core"), enc.alias("enc"))

    def fold(x: Column) -> Column:
        core = F.when(x["enc"].isin(0, 2), F.lower(x["core"])).otherwise(x["core"])
        alphabet = F.element_at(F.array(*[F.lit(a) for _, a, _ in ENCODINGS]), x["enc"] + 1)
        n = F.length(core)
        size = F.lit(0)
        for bound in LENGTHS:
            size = size + F.when(n >= bound, 1).otherwise(0)
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), core.alias("core"), alphabet.alias("alphabet"),
            (x["enc"] * 4 + size).alias("cls"), n.cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"),
        )

    def tally(x: Column) -> Column:
        halves = F.element_at(F.array(*[F.lit("0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2)) for _, a, _ in ENCODINGS]), F.floor(x["cls"] / 4).cast("int") + 1)
        bits = F.call_function("translate", x["core"], x["alphabet"], halves)
        values = F.transform(F.split(x["core"], ""), lambda c: F.instr(x["alphabet"], c).cast("double"))
        counts = F.transform(
            F.split(x["alphabet"], ""), lambda c: (x["n"] - F.length(F.replace(x["core"], c, F.lit("")))).cast("double")
        )
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["cls"].alias("cls"), x["n"].alias("n"), x["k"].alias("k"),
            bits.alias("bits"), values.alias("values"),
            F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c).alias("squares"),
        )

    def sums(x: Column) -> Column:
        mean = F.aggregate(x["values"], F.lit(0.0), lambda a, v: a + v) / x["n"]
        ones = F.length(F.replace(x["bits"], F.lit("0"), F.lit(""))).cast("double")
        turns = sum(
            (F.length(x["bits"]) - F.length(F.replace(x["bits"], F.lit(p), F.lit("")))) / 2 for p in ("01", "10")
        )
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["cls"].alias("cls"), x["n"].alias("n"), x["k"].alias("k"),
            x["squares"].alias("squares"), ones.alias("ones"), (turns + 1).cast("double").alias("runs"),
            F.transform(x["values"], lambda v: v - mean).alias("dev"),
        )

    def scores(x: Column) -> Column:
        n, k = x["n"], x["k"]
        chi = (k * x["squares"] / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        mixed = 2 * x["ones"] * (n - x["ones"]) / n
        var = mixed * (mixed - 1) / (n - 1)
        runs = F.when(var > 0, F.abs(x["runs"] - mixed - 1) / F.sqrt(var)).otherwise(F.lit(12.0))
        total = F.aggregate(x["dev"], F.lit(0.0), lambda a, v: a + v * v)
        shifted = F.slice(x["dev"], F.lit(2), F.greatest(F.size(x["dev"]) - 1, F.lit(0)))
        lag = F.aggregate(F.zip_with(x["dev"], shifted, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
        serial = F.when(total > 0, F.abs(lag / total + 1 / n) * F.sqrt(n)).otherwise(F.lit(12.0))
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["cls"].alias("cls"),
            chi.alias("chi"), runs.alias("runs"), serial.alias("serial"),
        )

    def logs(x: Column) -> Column:
        p = [_upper_tail(x["chi"]), 2 * _upper_tail(x["runs"]), 2 * _upper_tail(x["serial"])]
        half = -sum(F.log(F.greatest(F.least(q, F.lit(1.0)), F.lit(1e-30))) for q in p)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["cls"].alias("cls"), half.alias("half"))

    def fisher(x: Column) -> Column:
        p = F.exp(-x["half"]) * (1 + x["half"] + x["half"] * x["half"] / 2)  # chi-squared, 6 degrees of freedom
        return F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end"), x["cls"].alias("cls"), p.alias("p"))

    # Each step names its values, so that the next one doesn't compute them again for every use.
    array = F.filter(F.transform(tokens, encode), lambda x: x["enc"].isNotNull())
    for step in (fold, tally, sums, scores, logs, fisher):
        array = F.transform(array, step)
    return array


def thresholds(docs: DataFrame, fdr: float = 0.05) -> dict[int, float]:
    """The least p-value that counts as random, by class. Reads all documents; gathers at most 16 x 101 counts."""
    found = _with_spans(docs.select(text_or_empty().alias("__text")), "__tokens", TOKEN, 3)
    found = found.filter(F.size("__tokens") > 0).select(F.explode(judged(F.col("__tokens"))).alias("x"))
    step = F.floor(F.col("x.p") * STEPS).cast("int")
    counts: dict[int, list[int]] = {}
    for cls, b, n in found.groupBy(F.col("x.cls"), step).count().collect():
        counts.setdefault(cls, [0] * (STEPS + 1))[min(b, STEPS)] += n
    return least_p(counts, fdr)


def least_p(counts: dict[int, list[int]], fdr: float) -> dict[int, float]:
    """Storey's estimate: twice the tokens above 0.5 are random in all; the rest of those above t are text."""
    out = {}
    for cls, c in counts.items():
        random = 2 * sum(c[STEPS // 2 :])
        for t in range(1, STEPS // 2 + 1):
            above = sum(c[t:])
            if above and 1 - random * (1 - t / STEPS) / above <= fdr:
                out[cls] = t / STEPS
                break
    return out


def scan(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """docs with `found`: array of (start, kind, end) by start and kind, kind an index of KINDS.

    Null texts count as empty and find nothing; ids are never looked at, so null or repeated ids
    and repeated rows each keep their own result; a column named `found` is replaced. An empty table
    gives no rows, and no thresholds, so that none would count as random.
    """
    least = thresholds(docs, fdr)
    df = docs.withColumn("__text", text_or_empty())
    df = _with_spans(df, "__assign", ASSIGN, 0, least=8)
    df = _with_spans(df, "__access", ACCESS, 1)
    df = _with_spans(df, "__hex", HEX, 2)
    df = _with_spans(df, "__tokens", TOKEN, 3)
    df = df.withColumn("__judged", judged(F.col("__tokens")))
    def passes(x: Column) -> Column:
        limit = F.lit(2.0)
        for cls, p in sorted(least.items()):
            limit = F.when(x["cls"] == cls, F.lit(p)).otherwise(limit)
        return x["p"] >= limit

    def plain(c: str | Column) -> Column:
        return F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

    found = F.concat(plain("__assign"), plain("__access"), plain("__hex"), plain(F.filter("__judged", passes)))
    return df.withColumn("found", F.array_sort(found)).drop("__text", "__assign", "__access", "__hex", "__tokens", "__judged")


def _listed(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ","
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("found", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return df.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
    )
