"""Chat formatting with prefix-target expansion.

Every turn is rendered as one segment: a marker for its role, the text with control strings
escaped, an end marker. Every assistant turn is exploded into an example of its own: its context is
all segments before it, and only its own text is trainable. The examples of a conversation are all
prefixes of one rendering, so an example is a record of offsets in it: where its context ends, where
it ends itself, and its loss span. So the output has one segment a turn and one record an assistant
turn, and is linear in the input however long a conversation is; `examples` spells the prefixes out
as strings where a trainer wants them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgraph.llm.common import table

#: Characters that begin and end a control string of the template, and the escape character. They
#: never occur in an escaped text: each is written as the escape character and a letter.
OPEN, CLOSE, ESCAPE = "⟦", "⟧", "\u001b"
#: Control strings that trainers and other templates read (fixed values). They are broken up.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
END = f"{OPEN}end{CLOSE}"


def escaped(text: Column) -> Column:
    """The text without control strings; `unescape` gives it back."""
    out = F.coalesce(text, F.lit(""))
    for char, letter in ((ESCAPE, "e"), (OPEN, "o"), (CLOSE, "c")):
        out = F.replace(out, F.lit(char), F.lit(ESCAPE + letter))
    for control in CONTROLS:  # an escape and "x" after the first character break it up
        out = F.replace(out, F.lit(control), F.lit(control[0] + ESCAPE + "x" + control[1:]))
    return out


def unescape(text: str) -> str:
    """The inverse of `escaped`."""
    if ESCAPE not in text:
        return text
    parts = text.split(ESCAPE)
    return parts[0] + "".join({"e": ESCAPE, "o": OPEN, "c": CLOSE, "x": ""}[p[0]] + p[1:] for p in parts[1:])


FORMATTED = "conv_id, position, kind, segment, start, stop, example, loss_start, loss_stop".split(", ")


def formatted(conversations: DataFrame) -> DataFrame:
    """Rows of kind 'segment', one a turn, and of kind 'example', one an assistant turn.

    A segment has its text and its code points [start, stop) in the conversation's rendering. An
    example (numbered from 0) is the rendering up to stop; [0, start) is its context and
    [loss_start, loss_stop) its loss mask. position counts the turns of a conversation from 0, by
    (turn, role, text), nulls first; equal rows are turns of their own. A null text is empty, a null
    role is the role "" (never trainable), a null conv_id is a conversation of its own. Other columns
    aren't read. An empty table gives an empty result.

    A conversation is one window, in order and spilling: its running offsets need nothing but the
    last one, but it isn't split over tasks.
    """
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(OPEN), escaped(role), F.lit(CLOSE))
    turns = conversations.select("conv_id", "turn", role.alias("role"), head.alias("head"), escaped(F.col("text")).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    spoken = F.col("role") == "assistant"
    sized = turns.withColumn("segment", F.concat("head", "body", F.lit(END)))
    placed = sized.withColumns({"position": (F.row_number().over(order) - 1).cast("long"), "stop": F.sum(F.length("segment")).over(running), "number": F.sum(spoken.cast("long")).over(running) - 1})
    start = F.col("stop") - F.length("segment")
    none = F.lit(None).cast("long")
    row = lambda kind, text, *spans: F.struct(F.lit(kind).alias("kind"), text.alias("segment"), start.alias("start"), F.col("stop"), *[x.cast("long").alias(n) for n, x in zip(FORMATTED[-3:], spans)])
    turn = row("segment", F.col("segment"), none, none, none)
    example = row("example", F.lit(None).cast("string"), F.col("number"), start + F.length("head"), F.col("stop") - len(END))
    both = F.when(spoken, F.array(turn, example)).otherwise(F.array(turn))
    return placed.select("conv_id", "position", F.inline(both)).select(*FORMATTED)


def _in_order(rows: DataFrame) -> DataFrame:
    """Each conversation in one partition, a turn's segment before its example."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "position", F.desc("kind"))


def examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example, text, loss_start, loss_stop.

    text is the whole rendering up to the turn's end. The strings of a conversation grow with the
    square of its turns by nature; they are made row by row from one rendering, never all at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, so_far = object(), []
        for batch in batches:
            for conv_id, segment, first, last, k in zip(*(c.to_pylist() for c in batch.columns)):
                if conv_id != now:
                    now, so_far = conv_id, []
                if segment is not None:
                    so_far.append(segment)
                else:
                    so_far = ["".join(so_far)]
                    row = [[conv_id], [k], so_far, [first], [last]]
                    kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], ["conv_id", "example", "text", "loss_start", "loss_stop"])

    kind = conversations.schema["conv_id"].dataType.simpleString()
    ordered = _in_order(formatted(conversations)).select("conv_id", "segment", "loss_start", "loss_stop", "example")
    return ordered.mapInArrow(run, f"conv_id {kind}, example long, text string, loss_start long, loss_stop long")


def read_back(rows: DataFrame) -> DataFrame:
    """What formatted rows say, one row per conversation.

    conv_id, n_turns, turns_sha256 (role, \\n, text, \\n of each turn, from the segments), loss_chars
    and loss_sha256 (all text under the loss masks, from the examples' records and the rendering they
    point into), formatted_chars (of the rendering), n_examples, example_chars (of all examples spelt
    out). Hashes are fed turn by turn in order, so a long conversation needs no memory. A mask that
    lies outside its example's last segment is an error.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "example_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        kind, last = None, ("", 0, 0)

        def done() -> tuple:
            now, n, turns, chars, loss, stop, k, total = state
            return now, n, turns.hexdigest(), chars, loss.hexdigest(), stop, k, total

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 8, kinds)], names)

        for batch in batches:
            kind, found = batch.schema.field(0).type, []
            for conv_id, segment, start, stop, first, end in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv_id != state[0]:
                    if state is not None:
                        found.append(done())
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                if segment is not None:
                    at = segment.index(CLOSE)
                    role, body = unescape(segment[len(OPEN) : at]), unescape(segment[at + len(CLOSE) : -len(END)])
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    state[5] += len(segment)
                    last = (segment, start, stop)
                else:
                    if not last[1] <= first <= end <= last[2] == stop:
                        raise ValueError(f"conversation {conv_id}: mask [{first}, {end}) outside of the last turn")
                    text = unescape(last[0][first - last[1] : end - last[1]])
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
                    state[6] += 1
                    state[7] += stop
            yield batch_of(found)
        if state is not None:
            yield batch_of([done()])

    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = _in_order(rows).select("conv_id", "segment", "start", "stop", "loss_start", "loss_stop")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long")


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(pd.DataFrame({"conv_id": [-7, -7], "turn": [0, 1], "role": ["user", "assistant"], "text": [says, says]}), given.schema)
    return read_back(formatted(given.unionByName(more)))


QUERIES = {"op4_chat": _query}
