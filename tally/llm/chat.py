"""Chat formatting into budgeted, turn-aligned windows.

Prefix sums of turn tokens place every turn: short turns fall into windows of
half the free budget by their start, a turn longer than that has a window of
its own, so no window of several turns exceeds the budget.  Each window
retains the system turn and repeats the last turns of the window before it, up
to ``history`` tokens; what is repeated is masked, so every assistant text is a
target exactly once.

The prefix sums have two levels (chunks of turn numbers, then totals of
chunks), so a conversation of very many turns is no single task's work.

Template: ``<s>`` opens a window, a turn is ``[TURN] role [TEXT] text </s>`` and
a line break.  Control strings inside roles and texts get a backslash after
their first character (one more if they have some); removing one restores
them, so the escape is reversible and no control string survives in a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty, with_python

CHUNK = 1024  # turn numbers per chunk of the prefix sums
CONTROL = r"(?:s>|(?:TURN|TEXT|INST|SYS)\])"
_TURN = re.compile(r"\[TURN\] (.*?) \[TEXT\] (.*?) </s>\n", re.S)
_ESCAPED = re.compile(r"([<\[])\\(\\*/?" + CONTROL + ")")


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(\\*/?" + CONTROL + ")", r"$1\\$2")


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1\2", s)


def token_count(text: Column) -> Column:
    """Estimated tokens of a turn: a quarter of its characters, and its markers."""
    return (F.ceil(F.length(text) / 4) + 8).cast("long")


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def with_prefix(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, tokens`` and ``start``: the tokens of the turns before."""
    t = turns.withColumn("chunk", F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK))
    within = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text").rowsBetween(
        Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    totals = (t.groupBy("conv_id", "chunk").agg(F.sum("tokens").alias("n"))
              .select(F.col("conv_id").alias("k"), F.col("chunk").alias("c"),
                      F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    return (t.join(totals, _same(t["conv_id"], totals["k"]) & (t["chunk"] == totals["c"]))
            .select("conv_id", "turn", "role", "text", "tokens", (F.col("inner") + F.col("offset")).alias("start")))


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 128) -> DataFrame:
    """One row per window: ``conv_id, bin, solo`` (the window's place), ``text``,
    ``context`` (leading turns that repeat others), ``n_turns`` (turns in it),
    ``tokens`` and ``loss`` (code-point spans ``start``, ``end`` of the targets).

    Rows are ``conv_id, turn, role, text``; other columns are ignored.  A NULL
    text or role is empty, a NULL ``conv_id`` is a conversation of its own, a
    NULL turn comes first.  Turns of equal number are ordered by role and text;
    repeated rows are turns of their own.  Only a first turn of role ``system``
    is retained.  A single turn beyond the budget stays whole in its own window.
    """
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"),
                                 text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    turns = materialize(with_prefix(turns.withColumn("tokens", token_count(F.col("text")))), "chat-turns")
    system = turns.where("start = 0 and role = 'system'").select(
        F.col("conv_id").alias("k"), F.col("text").alias("system"), F.col("tokens").alias("system_tokens"))
    placed = turns.join(system, _same(turns["conv_id"], system["k"]), "left").drop("k")
    free = F.greatest(F.lit(budget - history) - F.coalesce("system_tokens", F.lit(0)), F.lit(budget // 4))
    placed = (placed.withColumn("half", (free / 2).cast("long"))
              .withColumn("bin", F.floor(F.col("start") / F.col("half")))
              .withColumn("solo", (F.col("tokens") > F.col("half")).cast("int")))
    windows = placed.groupBy("conv_id", "bin", "solo").agg(F.max(F.col("start") + F.col("tokens")).alias("end"))
    order = Window.partitionBy("conv_id").orderBy("bin", "solo")
    windows = windows.select(F.col("conv_id").alias("k"), F.col("bin").alias("b"), F.col("solo").alias("s"), "end",
                             F.lead(F.struct("bin", "solo")).over(order).alias("next"),
                             F.row_number().over(order).alias("ordinal"))
    placed = placed.join(windows, _same(placed["conv_id"], windows["k"]) & (placed["bin"] == windows["b"])
                         & (placed["solo"] == windows["s"])).drop("k", "b", "s")
    is_system = (F.col("start") == 0) & (F.col("role") == "system")
    own = F.struct(F.struct("bin", "solo").alias("at"), F.lit(False).alias("again"))
    later = F.struct(F.col("next").alias("at"), F.lit(True).alias("again"))
    repeats = F.col("next").isNotNull() & ~is_system & (F.col("end") - F.col("start") <= history)
    copies = placed.select("*", F.explode(F.when(repeats, F.array(own, later)).otherwise(F.array(own))).alias("copy"))
    head = F.concat(F.lit("[TURN] "), escape(F.col("role")), F.lit(" [TEXT] "))
    body = escape(F.col("text"))
    piece = F.struct(
        F.col("start"), F.col("copy.again").alias("again"), F.length(head).alias("head"), F.length(body).alias("body"),
        (~F.col("copy.again") & (F.col("role") == "assistant")).alias("loss"), F.col("tokens"),
        F.concat(head, body, F.lit(" </s>\n")).alias("piece"))
    grouped = copies.groupBy("conv_id", "copy.at").agg(
        F.sort_array(F.collect_list(piece)).alias("turns"), F.max("system").alias("system"),
        F.max("system_tokens").alias("system_tokens"), F.min("start").alias("first"))
    # the system turn opens every window but its own
    lead = F.when(F.col("system").isNotNull() & (F.col("first") > 0), F.array(F.struct(
        F.lit(0).cast("long").alias("start"), F.lit(True).alias("again"), F.lit(0).alias("head"), F.lit(0).alias("body"),
        F.lit(False).alias("loss"), F.col("system_tokens").alias("tokens"),
        F.concat(F.lit("[TURN] system [TEXT] "), escape(F.col("system")), F.lit(" </s>\n")).alias("piece"))))
    grouped = grouped.withColumn("turns", F.concat(F.coalesce(lead, F.array().cast(grouped.schema["turns"].dataType)), "turns"))
    spans = F.aggregate(
        "turns", F.struct(F.lit(3).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["piece"])).alias("at"),
            F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + x["head"]).alias("start"), (acc["at"] + x["head"] + x["body"]).alias("end")))))
            .otherwise(acc["spans"]).alias("spans")))
    return grouped.select(
        "conv_id", F.col("at.bin").alias("bin"), F.col("at.solo").alias("solo"),
        F.concat(F.lit("<s>"), F.array_join(F.transform("turns", lambda x: x["piece"]), "")).alias("text"),
        F.size(F.filter("turns", lambda x: x["again"])).alias("context"), F.size("turns").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"),
        spans["spans"].alias("loss"))


def read_windows(text: str, context: int) -> list[tuple[str, str]]:
    """The ``(role, text)`` turns of a window that do not repeat others."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text[3:])[context:]]


def digest(windows: DataFrame) -> DataFrame:
    """Read the windows back, per conversation: ``conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars``.  The windows of a conversation
    stream through a running digest; they are never held together."""
    cols = ["conv_id", "text", "context", "loss"]
    ordered = (windows.repartition("conv_id").sortWithinPartitions("conv_id", "bin", "solo").select(*cols))
    kind = windows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, None, []

        def closed():
            return [key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        def out():
            columns = list(zip(*rows)) or [()] * 6
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for conv, text, context, loss in zip(*(b.column(i).to_pylist() for i in range(4))):
                if state is None or conv != key:
                    if state is not None:
                        rows.append(closed())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_windows(text, context):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    target = unescape(text[span["start"]:span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield out()
            rows = []
        if state is not None:
            rows = [closed()]
            yield out()

    return with_python(ordered).mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
