"""Chat formatting with budgeted windows.

A conversation becomes one or more training windows. Prefix sums of its turns' tokens choose spans of whole
turns: each window has the system turn, some repeated history and as many new turns as the budget allows.
Repeated turns are there to be read, not learned: the loss mask covers every assistant text exactly once over
all windows. Texts and roles are escaped, so that control strings in them can't be taken for the template's;
parsing undoes that exactly.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm.common import bounded_batches, require, table

NAME = "op2_chat_formatting"
ORACLE_SQL = None  # the template is this module's own; tests compare the text read back with the turns
BUDGET, HISTORY = 1024, 256
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates; inside texts all of them are escaped.
CONTROL = (TURN, BODY, END, "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_HEADS = sorted({c[0] for c in CONTROL})
_TAILS = {h: "|".join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True) if c[0] == h) for h in _HEADS}
#: A control string's first character, backslashes, its rest: escaping adds one backslash, reading takes one.
_ESCAPE = re.compile("|".join(rf"(?<={re.escape(h)})(?=\\*(?:{t}))" for h, t in _TAILS.items()))
_UNESCAPE = re.compile("|".join(rf"(?<={re.escape(h)})\\(?=\\*(?:{t}))" for h, t in _TAILS.items()))
_PARSE = re.compile(rf"{re.escape(TURN)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


WINDOWS = "conv_id long, window int, text string, loss array<struct<start: int, stop: int>>, n_repeated int, n_new int, n_tokens long"


def _windows(turns, budget: int, history: int, first: int, system):
    """The next full window over buffered (role, text, tokens) turns. first: how many of them were shown
    already. Returns the turns shown, how many are repeated, and the index after the last one."""
    sizes = np.array([t[2] for t in turns])
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = first
    while at > 0 and total[first] - total[at - 1] <= history:
        at -= 1
    base = system[2] if system and first else 0
    room = budget - base
    while at < first and total[first + 1] - total[at] > room:
        at += 1  # history gives way to the next new turn
    end = int(np.searchsorted(total, total[at] + room, "right")) - 1
    end = max(end, first + 1)  # a turn over the budget stands alone
    shown = ([system] if base else []) + turns[at:end]
    return shown, len(shown) - (end - first), end


def _render(conv, number, shown, repeated):
    parts, loss, at = [], [], 0
    for i, (role, text, _) in enumerate(shown):
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        if role == "assistant" and i >= repeated:
            loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        parts += head, body, END
        at += len(head) + len(body) + len(END)
    return {"conv_id": conv, "window": number, "text": "".join(parts), "loss": loss, "n_repeated": repeated, "n_new": len(shown) - repeated, "n_tokens": int(sum(t[2] for t in shown))}


class _Conversation:
    """One conversation while its turns pass by in order; holds a window's turns and its history at most."""

    def __init__(self, conv, budget, history):
        self.conv, self.budget, self.history = conv, budget, history
        self.system, self.turns, self.first, self.number, self.seen = None, [], 0, 0, 0

    def add(self, role, text, tokens):
        turn = (role, text, tokens)
        if self.seen == 0 and role == "system":
            self.system = turn
        self.seen += 1
        self.turns.append(turn)
        while sum(t[2] for t in self.turns[self.first :]) > self.budget and len(self.turns) - self.first > 1:
            yield self.cut()

    def cut(self):
        shown, repeated, end = _windows(self.turns, self.budget, self.history, self.first, self.system)
        out = _render(self.conv, self.number, shown, repeated)
        self.number += 1
        keep, size = end, 0
        while keep > 0 and size + self.turns[keep - 1][2] <= self.history and not (keep == 1 and self.turns[0] is self.system):
            keep -= 1
            size += self.turns[keep][2]
        self.turns, self.first = self.turns[keep:], end - keep
        return out

    def finish(self):
        while len(self.turns) > self.first:
            yield self.cut()


def token_count(col):
    """Tokens of a turn: its words and signs, and the three marks."""
    return F.regexp_count(col, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 3


def format_chats(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=token_count) -> DataFrame:
    """One row per window. ``conversations`` has conv_id, turn, role, text; rows are read by turn (null
    first), then role and text where turns tie; a null text or role is empty; rows of a null conv_id are one
    conversation. Text and loss spans count code points. Conversations are spread by conv_id and stream
    through a task in order, so a long one takes time, not memory. A turn over the budget gets a window of
    its own (over the budget, never cut)."""
    rows = require(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("n", tokens(F.col("text")).cast("long"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    type_ = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("n_repeated", pa.int32()), ("n_new", pa.int32()), ("n_tokens", pa.int64())])

    def run(batches):
        now = None
        for b in batches:
            out = []
            for conv, role, text, n in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "n")), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out += now.finish()
                    now = _Conversation(conv, budget, history)
                out += now.add(role, text, n)
            yield pa.RecordBatch.from_pylist(out, schema=type_)
        if now is not None:
            yield pa.RecordBatch.from_pylist(list(now.finish()), schema=type_)

    return bounded_batches(rows).mapInArrow(run, WINDOWS)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a window."""
    return [(unescape(r), unescape(t)) for r, t in _PARSE.findall(text)]


def read_back(windows: DataFrame) -> DataFrame:
    """Counts and digests per conversation, from formatted windows alone. The windows of a conversation must
    be in one partition in order, as ``format_chats`` leaves them; digests are fed window by window."""
    type_ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def run(batches):
        now, state = None, None
        close = lambda: {"conv_id": now[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4], "n_windows": state[5]}
        for b in batches:
            out = []
            for conv, text, loss, repeated in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "loss", "n_repeated")), strict=True):
                if now != (conv,):
                    if now is not None:
                        out.append(close())
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    learned = unescape(text[span["start"] : span["stop"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
                state[5] += 1
            yield pa.RecordBatch.from_pylist(out, schema=type_)
        if now is not None:
            yield pa.RecordBatch.from_pylist([close()], schema=type_)

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    chats = require(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return read_back(format_chats(chats.unionByName(own)))
