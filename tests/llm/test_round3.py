"""Source divergence, personal data and the conversation trie against brute force, and their defined results in odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from promolens.llm import divergence, personal, prefixes

TINY = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
HUGE = "word " * 20000


# op11
def audit_rows(docs, least, top):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    n, where, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in docs):
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.translate(lower))
        groups.add((lang, source))
        n[lang, source].update(words)
        where[lang].update(set(words))
    out = set()
    for lang, source in groups:
        kept = [w for w, k in where[lang].items() if k >= least]

        def shares(of, kept=kept):
            total = sum(of[w] for w in kept)
            return {w: 1 + 10**9 * (of[w] + 5) // (total + 5 * len(kept)) for w in kept}

        others = sorted(s for g, s in groups if g == lang and s != source)
        mine, whole = shares(n[lang, source]), shares(sum((n[g] for g in groups if g[0] == lang), Counter()))
        pairs = [(sum(abs(mine[w] - p) for w, p in shares(n[lang, o]).items()), o) for o in others]
        terms = [(mine[w] - whole[w], w) for w in kept if n[lang, source][w] and mine[w] > whole[w]]
        for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
            out |= {(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)}
    return out


def divergent(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS)


@pytest.mark.parametrize(("bits", "slice_rows", "block"), [(64, 100_000, 256), (5, 40, 256), (64, 30, 2)])
def test_divergence_equals_brute_force(spark, bits, slice_rows, block):
    rng = random.Random(3)
    words = [f"{a}{b}é" for a in "ABcdxyz" for b in "klmnop"] + ["the", "The", "x1y", "d'or"]
    rows = [(" ".join(rng.choices(words[: rng.randint(2, len(words))], k=rng.randint(0, 25))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "Ü", "c", "d", None])) for _ in range(120)]
    rows += [(None, "en", "empty"), ("", "xx", "alone"), ("solo", "yy", "s"), ("duo", "yy", "t"), (HUGE, "en", "a"), *[rows[0]] * 3]
    got = divergence.audit(divergent(spark, rows), 4, 7, bits, slice_rows, block)
    assert {tuple(r) for r in got.collect()} == audit_rows(rows, 4, 7)


def test_terms_of_long_texts():
    text = ("ab Cd" * 10 + " ").encode() * 200_000 + b"x" * (divergence.PIECE + 7) + " Énd".encode()
    pieces = list(divergence.terms_of(text))
    assert len(pieces) > 2 and sum(pieces, []) == text.translate(divergence.LETTERS).split()


def test_divergence_of_an_empty_table_and_of_clashing_columns(spark):
    rows = [("a b c", "en", s) for s in "xy"]
    assert divergence.audit(divergent(spark, rows).filter("false")).count() == 0
    df = divergent(spark, rows).withColumns({c: F.lit("own") for c in ("digest", "split", "n", "item", "value", "rank", "key")})
    assert {tuple(r) for r in divergence.audit(df, 2).collect()} == audit_rows(rows, 2, 50)


# op12
BASE = {
    0: (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    1: (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    2: (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0),
    3: (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_of(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0]))


def found_of(texts, rounds=3, support=3.0, trust=0.75):
    """Spans of each text, with the graph kept as plain sets."""
    base, mentions = [base_of(t) for t in texts], []
    for row, t in enumerate(texts):
        t = t or ""
        hits = list(re.finditer(personal.MENTION.replace(r"\x22", '"'), t))
        edges = [0, *[x for m in hits for x in m.span()], len(t)]
        for i, m in enumerate(hits):
            core = re.sub(r"^[^A-Za-z0-9+(@#]+", "", m[0])
            start = m.end() - len(core)
            core = re.sub(r"[^A-Za-z0-9)]+\Z", "", core)
            end = start + len(core)
            before, after = t[edges[2 * i] : m.start()], t[m.end() : edges[2 * i + 3]]
            left = ("^ ^ " + before[-64:]).lower().split()
            right = (after[:64] + " $").lower().split()
            spans = [(a, b) for a, _, b in base[row]]
            seed = (start, end) in spans
            clash = any(a < end and b > start for a, b in spans)
            looks = len(core) >= 6 and (len(re.sub("[^0-9]", "", core)) >= 3 or re.search("[A-Za-z0-9]@[A-Za-z0-9]", core))
            if seed or (looks and not clash):
                mentions.append((row, start, end, core.lower(), (("before", *left[-2:]), ("around", left[-1], right[0])), seed))
    seeds = {m[3] for m in mentions if m[5]}
    members = defaultdict(set)
    for _, _, _, core, patterns, _ in mentions:
        for p in patterns:
            members[p].add(core)
    score = {}
    for _ in range(rounds):
        good = {}
        for p, ids in members.items():
            total = sum(1.0 if i in seeds else score.get(i, 0.0) for i in ids)
            if len(ids) >= support and total >= support and total / (len(ids) + 1) >= trust:
                good[p] = total / (len(ids) + 1)
        score = {}
        for p, c in good.items():
            for i in members[p] - seeds:
                score[i] = 1 - (1 - score.get(i, 0.0)) * (1 - c)
    for row, start, end, core, _, seed in mentions:
        if not seed and score.get(core, 0) >= trust:
            base[row].append((start, 4, end))
    return [sorted(x) for x in base]


def spans_of(df):
    return [[tuple(x) for x in r.found] for r in df.orderBy("doc_id").collect()]


def personal_docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


PIECES = [
    "bob.x@mail.example.com", "a@b.c_d@e.f", "x@y", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0000255.0.0.01", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713",
    "+1 (017) 555-7713", "+12", "AB-1234-77", "(555) 123-4567", "é\U0001f600", "word", " ", " ", " ", ",", "\n", ": ", "write to ", "call me at ", "x1+1 (017) 555-7713", "'", "=",
]


def test_personal_base_equals_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PIECES) for _ in range(14)) for _ in range(250)] + [None, "", HUGE, "9" * 3000, "a." * 3000 + "@", "a@" + "b." * 3000 + "c", "1." * 3000 + "2", "!" * 5000 + "1"]
    got = spans_of(personal.find(personal_docs(spark, texts)))
    assert [[x for x in row if x[1] < 4] for row in got] == [base_of(t) for t in texts]


def seeded_texts():
    rng = random.Random(5)
    texts = []
    for i in range(60):
        lead = rng.choice(["please call me at", "my mail is", "the order of", "version"])
        thing = {"please call me at": f"+1 ({rng.randint(100, 999)}) 555-{i:04}", "my mail is": f"u{i}@mail.example.com", "the order of": f"{rng.randint(10**6, 10**7)}", "version": "2.0.1234"}[lead]
        texts.append(f"Well {lead} {thing} {rng.choice(['today', 'now', 'or later'])}.")
    texts += ["Well please call me at 555-0199-77 today.", "And my mail is: jane9@work or later.", "the order of 1234567 now", "Well please call me at 555-0199-77 or so", None, "", texts[0], texts[0]]
    return texts


def test_personal_contexts_equal_brute_force(spark):
    rng = random.Random(6)
    for texts in (seeded_texts(), [" ".join(rng.choice([*PIECES, "at", "to", "of"]) for _ in range(9)) for _ in range(150)]):
        assert spans_of(personal.find(personal_docs(spark, texts))) == found_of(texts)


def test_personal_contexts_find_unseen_identifiers(spark):
    texts = seeded_texts()
    got = spans_of(personal.find(personal_docs(spark, texts)))
    learned = {(i, texts[i][a:b]) for i, row in enumerate(got) for a, k, b in row if k == 4}
    assert learned == {(60, "555-0199-77"), (63, "555-0199-77")}


def test_personal_odd_rows(spark):
    df = spark.createDataFrame([(None, "a@b.cc"), (1, "a@b.cc"), (1, "a@b.cc"), (2, None)], "doc_id long, text string").withColumn("found", F.lit("mine")).withColumn("score", F.lit(1)).withColumn("start", F.lit(2))
    out = personal.find(df)
    assert sorted((r.doc_id or 0, len(r.found), r.score, r.start) for r in out.collect()) == [(0, 1, 1, 2), (1, 1, 1, 2), (1, 1, 1, 2), (2, 0, 1, 2)]
    assert personal.find(df.filter("false")).count() == 0
    assert "text" not in personal.find(df, with_text=False).columns


def test_personal_query(spark):
    import pandas as pd

    texts = pd.read_parquet(f"{TINY}/documents.parquet", columns=["doc_id", "text"])
    want = dict(zip(texts["doc_id"], found_of(list(texts["text"])), strict=True))
    rows = personal.op12_personal_data(spark, TINY).collect()
    assert len(rows) == len(texts) and any(r.n_email for r in rows)
    for r in rows:
        listed = lambda x: ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in x)
        assert r.spans == listed(want[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed([x for x in want[r.doc_id] if x[1] < 4]).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want[r.doc_id]) for i in range(4)]


# op13
TALK = "conv_id long, turn long, role string, text string"


def trie_rows(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    talks = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    nodes = defaultdict(list)
    for c, t in talks.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        t = talks.get(base, [])[:h] + t[h:]
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append((c, d == len(t)))
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)
        words = lambda p: len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        out.add((
            min(c for c, _ in members), len(path), min(c for c, _ in nodes[path[:-1]]) if path else None, len(members), kids(path), sum(not kids(p) for p in below),
            sum((len(nodes[p]) - 1) * words(p) for p in below), hashlib.sha256(",".join(map(str, sorted(c for c, e in members if e))).encode()).hexdigest(),
        ))
    return out


@pytest.mark.parametrize(("limit", "window"), [(256, 16), (1, 1), (2, 2), (5, 3)])
def test_trie_equals_brute_force(spark, limit, window):
    rng = random.Random(7)
    rows = []
    for c in [*range(-3, 60), 100, 141]:
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "b c", "d  e\tf"])))
    rows += [(c, t, "user", "same words here") for c in range(200, 240) for t in range(5)]  # copies
    rows += [(c, t, "u", "grows") for c in range(300, 315) for t in range(c - 299)]  # each a prefix of the next
    rows += [(400, None, None, None), (400, 3, "user", None), (400, 3, "user", None), (401, 1, "", "x" * 50_000), (None, 1, "user", "lost"), (402, 1, "us", "er"), (403, 1, "u", "ser")]
    rng.shuffle(rows)
    got = prefixes.prefix_trie(prefixes.rebuilt(prefixes.sequences(spark.createDataFrame(rows, TALK))), limit, window)
    assert {tuple(r) for r in got.collect()} == trie_rows(rows)


def test_trie_of_an_empty_table_and_of_clashing_columns(spark):
    rows = [(1, 0, "user", "hi there"), (2, 0, "user", "hi there")]
    df = spark.createDataFrame(rows, TALK)
    assert prefixes.prefix_trie(prefixes.rebuilt(prefixes.sequences(df.filter("false")))).count() == 0
    df = df.withColumns({c: F.lit(0) for c in ("base", "turns", "key", "head", "container", "depth", "n")})
    assert {tuple(r) for r in prefixes.prefix_trie(prefixes.rebuilt(prefixes.sequences(df))).collect()} == trie_rows(rows)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_conversation_trie"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    from promolens.llm.queries import QUERIES, SQL

    con, folder = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(names)} from ({SQL[name]})").fetchall()
    assert len(want) > 300 and Counter(map(tuple, df.select(names).collect())) == Counter(want)
