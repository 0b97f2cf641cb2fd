"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are
context, and only that reply is trainable. Turns after the last reply (and
conversations without any) give one more row without a trainable part, so the
output holds every turn. A turn is written ``### role: text</turn>\\n``; control
strings inside roles and texts are escaped with backslashes, reversibly.

Defined results: null roles and texts are empty, rows are ordered by turn (null
first), then role and text; equal rows stay as many turns; a null conv_id is one
conversation; extra columns are ignored; an empty table gives no examples. A
conversation is streamed through one task in order: memory is its own length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "### ", "</turn>"
TRAINED = "assistant"
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
BATCH_CHARS = 4 << 20


def escape(text: str) -> str:
    """No ``###`` and no ``</turn>`` remains, and every backslash precedes a literal character."""
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int]:
    """A turn, and where its text begins in it."""
    head = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: "
    return f"{head}{escape(text)}{CLOSE}\n", len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted example."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a turn at character {at}")
    return turns


def expand(turns: Iterable[tuple[str, str]]) -> Iterator[tuple[int, int, str, int, int]]:
    """(example, n_turns, formatted, loss_start, loss_end) of a conversation's turns, in order."""
    prefix, n, shown, example = [], 0, 0, 0
    for role, text in turns:
        block, lead = render(role, text)
        n += 1
        if role == TRAINED:
            before = "".join(prefix)
            prefix = [before + block]
            yield example, n, prefix[0], len(before) + lead, len(before) + len(block) - len(CLOSE) - 1
            example, shown = example + 1, n
        else:
            prefix.append(block)
    if n > shown:
        yield example, n, "".join(prefix), 0, 0


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple[str, str]]]]:
    """Runs of one conv_id among sorted rows, across batches."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for conv, run in groupby(rows, key=lambda r: r[0]):
        yield conv, ((role, text) for _, role, text in run)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, formatted, loss_start, loss_end); the mask is a range of code points."""
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    common.bounded_batches(turns.sparkSession)
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    names = ["conv_id", "example", "n_turns", "formatted", "loss_start", "loss_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, conv_type = [], 0, pa.int64()

        def out() -> pa.RecordBatch:
            kinds = [conv_type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal conv_type
            for b in batches:
                conv_type = b.schema.field(0).type
                yield b

        for conv, own in _conversations(typed()):
            for e in expand(own):
                held.append((conv, *e))
                size += len(e[2])
                if size >= BATCH_CHARS or len(held) >= 5000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return rows.mapInArrow(run, f"conv_id {kind}, example long, n_turns long, formatted string, loss_start long, loss_end long")


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, examples long"


def read_back(examples: DataFrame, arranged: bool = False) -> DataFrame:
    """One row per conversation, from its examples alone.

    ``arranged``: each conversation's examples stand together and in order, as
    ``format_conversations`` gives them, so they need no shuffle.

    Each reply is read under its own example's mask; the turns come from the
    last example, the only one that is parsed, as the others are its prefixes
    (a check). Examples are streamed in order, so one is in memory at a time.
    """
    kind = examples.schema["conv_id"].dataType.simpleString()
    n = int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = examples if arranged else examples.repartition(n, "conv_id").sortWithinPartitions("conv_id", "example")
    rows = rows.select("conv_id", "formatted", "loss_start", "loss_end")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "examples"]

    def one(own: Iterable[tuple[str, int, int]]) -> tuple[int, str, int, str, int, int]:
        loss, chars, total, last, n = hashlib.sha256(), 0, 0, "", 0
        for formatted, start, end in own:
            if not formatted.startswith(last):
                raise ValueError("an example is no prefix of the next")
            reply = unescape(formatted[start:end])
            loss.update(reply.encode())
            chars, total, last, n = chars + len(reply), total + len(formatted), formatted, n + 1
        turns = parse(last)
        whole = hashlib.sha256()
        for role, text in turns:
            whole.update(f"{role}\n{text}\n".encode())
        return len(turns), whole.hexdigest(), chars, loss.hexdigest(), total, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        held, conv_type = [], pa.int64()

        def typed() -> Iterator[tuple]:
            nonlocal conv_type
            for b in batches:
                conv_type = b.schema.field(0).type
                yield from zip(*(c.to_pylist() for c in b.columns))

        def out() -> pa.RecordBatch:
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

        for conv, own in groupby(typed(), key=lambda r: r[0]):
            held.append((conv, *one(r[1:] for r in own)))
            if len(held) >= 5000:
                yield out()
                held = []
        if held:
            yield out()

    return rows.mapInArrow(run, f"conv_id {kind}, {_DIGEST}")


#: A conversation of nothing but control strings, which every run formats too.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    back = read_back(format_conversations(turns.unionByName(probe)), arranged=True)
    return back.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


_ESC = r"replace(replace(replace({0}, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')"

OP6_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
o AS (
  SELECT *, row_number() OVER w AS i,
         sum(4 + length(replace({_ESC.format("role")}, ':', '\\:')) + 2 + length({_ESC.format("text")}) + 8) OVER w AS upto,
         lead(1) OVER w IS NULL AS is_last
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR is_last THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""
