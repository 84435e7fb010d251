"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, then the
reply, which alone is trainable. Turns that follow the last reply make one more example without
a target, so that the formatted output holds the whole conversation. A turn is rendered as

    ### Role: text </turn>\\n

and inside texts and roles a backslash is put before each backslash, each `###` and each `</turn>`,
so the controls can't be forged and the original text comes back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.common import ship_by_value, table

ship_by_value(__name__)

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
EXAMPLES = "conv_id long, example int, text string, loss_start long, loss_end long"
_CONTROL = re.compile(r"\\|###|</turn>|:")
_TEXT_CONTROL = re.compile(r"\\|###|</turn>")
#: Role and text as rendered: neither holds an unescaped control.
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\]|\\.)*?) </turn>\n", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    return (_CONTROL if role else _TEXT_CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text begins and ends in it."""
    head, body = OPEN + escape(role, role=True) + MIDDLE, escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of an example."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError("the text isn't a sequence of turns")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def expand(turns: list[tuple[str, str]]) -> Iterator[tuple[str, int, int]]:
    """(text, loss_start, loss_end) of a conversation's examples; an example without target has an empty span."""
    prefix, target = "", True
    for role, text in turns:
        turn, a, b = render(role, text)
        a, b = a + len(prefix), b + len(prefix)
        prefix += turn
        target = role == "assistant"
        if target:
            yield prefix, a, b
    if not target:
        yield prefix, len(prefix), len(prefix)


def conversations_in(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order. Null roles and texts are empty; ties and
    repeated rows are all kept, ordered by role and text; turns without conv_id form one conversation,
    those without a turn number come first."""
    turn = F.struct(
        "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end), example from 0 within a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part: list[tuple] = []
                size = 0
                for i, (text, a, b) in enumerate(expand([(t["role"], t["text"]) for t in turns])):
                    part.append((conv_id, i, text, a, b))
                    size += len(text)
                    if size > 1 << 22:
                        yield _rows(part)
                        part, size = [], 0
                if part:
                    yield _rows(part)

    return conversations_in(conversations).mapInArrow(run, EXAMPLES)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
    names = ("conv_id", "example", "text", "loss_start", "loss_end")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples' texts and loss spans alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. The last example holds all turns; each example's loss
    span is one reply."""
    schema = "conv_id long, example int, n_turns long, turns_sha256 string, loss string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, loss, chars = [], [], [], []
            for text, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "loss_start", "loss_end")), strict=True):
                turns = parse(text)
                n.append(len(turns))
                digest.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                loss.append(unescape(text[a:b]))
                chars.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("example"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(loss, pa.string()), pa.array(chars, pa.int64())],
                ["conv_id", "example", "n_turns", "turns_sha256", "loss", "formatted_chars"],
            )

    read = examples.mapInArrow(run, schema)
    whole = read.groupBy("conv_id").agg(
        F.max_by("n_turns", "example").alias("n_turns"),
        F.max_by("turns_sha256", "example").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("formatted_chars").alias("formatted_chars"),
    )
    return whole.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations and conversation -7, whose texts hold this template's own controls."""
    said = r"\### Assistant: </turn> ok"
    hard = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(given.unionByName(hard)))


#: The same in DuckDB: lengths of the rendered turns, summed over the examples' prefixes.
OP6_SQL = r"""
WITH given AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         length('### :  </turn>') + 1 + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) AS chars
  FROM given
), prefixes AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix, count(*) OVER (PARTITION BY conv_id) AS n FROM turns
)
SELECT conv_id, any_value(n)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(prefix) FILTER (role = 'assistant' OR pos = n)::BIGINT AS formatted_chars
FROM prefixes GROUP BY conv_id
"""
