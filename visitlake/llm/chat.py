"""Chat logs folded into final messages and rendered: event-sourced reconstruction of conversations."""
from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: turn marks of the template; they and the control strings of common chat formats are escaped inside roles and texts
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED_ROLE = "assistant"
#: characters of rendered text that one row carries before a conversation is put together
CHUNK_CHARS = 1_000_000
#: kinds of events that start a message's text anew; `delta` adds to it
RESETS = ("message", "edit", "regenerate")

_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))


def escape(text: str) -> str:
    """Backslashes are doubled and one is put behind the first character of every control string, so none is left in the result."""
    return _CONTROL.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    """Roles are also free of line ends, which close them in the template."""
    return escape(role).replace("\n", "\\n")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of event logs: conv_id, position, role, text, n_events.

    `events` has conv_id, seq, kind, msg (a message's key within its conversation), role and text. A message's text is that of its
    last `message`, `edit` or `regenerate` event and of all `delta` events after it, in order of seq; before any of these, of all its
    deltas. A `delete` as its last word but deltas removes it until another reset. Its position is its first seq, its role the
    role of its first event that has one. Events are combined where they are read, by message and not by conversation, so a
    conversation with very many messages is not gathered here.

    A NULL text is empty. A NULL seq comes before all others; events of equal seq are ordered by kind, then text. NULL keys are
    keys. Unknown kinds do nothing. Other columns are not read.
    """
    known = events.where(F.col("kind").isin(*RESETS, "delta", "delete"))
    order = F.struct(F.col("seq").isNotNull().alias("known"), F.col("seq"))
    reset = F.col("kind").isin(*RESETS, "delete")
    entry = F.struct(order.alias("at"), (~reset).alias("delta"), F.col("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("role"))
    grouped = known.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(entry)).alias("log"))
    starts = F.filter(F.transform("log", lambda e, i: F.when(~e["delta"], i)), lambda i: i.isNotNull())
    live = F.when(F.size(starts) > 0, F.slice("log", F.array_max(starts) + 1, F.size("log"))).otherwise(F.col("log"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    rows = grouped.withColumn("live", live).where(F.col("live")[0]["kind"] != "delete")
    return rows.select("conv_id", F.col("log")[0]["at"]["seq"].alias("position"), F.get(roles, F.lit(0)).alias("role"),
                       F.array_join(F.transform("live", lambda e: e["text"]), "").alias("text"), F.size("log").alias("n_events"))


def render(messages: DataFrame, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """Formatted conversations: conv_id, n_turns, formatted, loss (array of start and end of learned text, in code points).

    `messages` has conv_id, position, role and text. They are sorted over the whole table by conversation and position, so a
    conversation with a large share of all messages is spread over many tasks; each renders what it has into pieces of about
    `CHUNK_CHARS`, and only these meet to be joined. The result itself is one value, so a conversation must fit one row.

    NULL roles and texts are empty. Messages of equal position are ordered by role, then text. NULL conv_ids are one conversation.
    """
    id_type = messages.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", id_type), T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
                           T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()),
                           T.StructField("spans", T.ArrayType(T.LongType()))])

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, chunk = TaskContext.get().partitionId(), 0
        key, held = None, None

        def row() -> tuple:
            return (key, part, chunk, held["turns"], "".join(held["texts"]), held["spans"])

        for frame in batches:
            out = []
            for conv, missing, role, text in zip(frame["conv_id"], frame["missing"], frame["role"], frame["text"]):
                conv = None if missing else conv
                if held is not None and (conv != key or held["chars"] >= CHUNK_CHARS):
                    out.append(row())
                    chunk, held = chunk + 1, None
                if held is None:
                    key, held = conv, {"turns": 0, "texts": [], "spans": [], "chars": 0}
                own, head = escape(text), START + escape_role(role) + MIDDLE
                if role == learned_role:
                    at = held["chars"] + len(head)
                    held["spans"] += [at, at + len(own)]
                held["texts"].append(head + own + END)
                held["chars"] += len(head) + len(own) + len(END)
                held["turns"] += 1
            if out:
                yield frame_of(out)
        if held is not None:
            yield frame_of([row()])

    def frame_of(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=schema.names)
        out["conv_id"] = pd.Series([r[0] for r in rows], dtype=object)
        return out

    rows = messages.select("conv_id", "position", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "position", "role", "text"]
    spread = rows.repartitionByRange("conv_id", "position", "role").sortWithinPartitions(*order)
    spread = spread.select(F.coalesce("conv_id", F.lit(0).cast(id_type)).alias("conv_id"), F.col("conv_id").isNull().alias("missing"), "role", "text")
    pieces = spread.mapInPandas(chunks, schema)
    piece = F.struct("part", "chunk", "formatted", "spans", F.char_length("formatted").cast("bigint").alias("chars"))
    whole = pieces.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    moved = F.aggregate("pieces", F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("spans")),
                        lambda s, p: F.struct((s["at"] + p["chars"]).alias("at"), F.concat(s["spans"], F.transform(p["spans"], lambda x: x + s["at"])).alias("spans")),
                        lambda s: s["spans"])
    pairs = F.expr("transform(sequence(0, size(flat) div 2 - 1), i -> struct(flat[2 * i] as start, flat[2 * i + 1] as end))")
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return (whole.select("conv_id", "n_turns", F.array_join(F.transform("pieces", lambda p: p["formatted"]), "").alias("formatted"), moved.alias("flat"))
            .select("conv_id", "n_turns", "formatted", F.when(F.size("flat") > 0, pairs).otherwise(nothing).alias("loss")))


def format_conversations(events: DataFrame) -> DataFrame:
    """Event logs to formatted conversations with their loss mask: `fold_events`, then `render`."""
    return render(fold_events(events))


_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END), re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation, unescaped."""
    return [(unescape_role(m.group(1)), unescape(m.group(2))) for m in _TURN.finditer(formatted)]


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), role, flags=re.DOTALL)


def learned_text(formatted: str, loss: list[tuple[int, int]]) -> str:
    return "".join(unescape(formatted[a:b]) for a, b in loss)
