"""Chat formatting in budgeted windows.

A conversation becomes training windows of whole turns. Prefix sums of the turns' tokens choose each
span: as many new turns as the budget leaves room for, besides the system turn, which every window
repeats, and a limited history of the turns before. Targets are the assistant's texts; those that a
window only repeats are masked, so that each is trained on once.

The template marks turns as ``<|turn role=R|>\\n … <|end|>\\n``. Control strings inside texts — these
marks' opening and those of other common templates — are escaped by a backslash after their first
character; one that has backslashes there already gets one more, so that escaping can be undone.

A conversation is read as a stream of turns in order; a task holds the turns of one window at a time,
however long the conversation is. Defined results: a null text or role counts as empty; turns without a
number come first and turns with the same number follow in order of role and text, none is dropped; a
null conv_id is one conversation; a turn that is larger than the budget is a window of its own and stays
whole. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain, groupby
from urllib.parse import quote, unquote

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import RANKS, encode_text, encoding
from ledgerloom.llm.common import batches_of, table

#: Tokens of a window and of the history in it; tokens that the marks of a turn count for.
BUDGET, HISTORY, MARKS = 2048, 512, 6

_CONTROL = re.compile(r"([<\[])(\\*)(\||/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(\||/?s>|/?INST\])")
_TURN = re.compile(r"<\|turn role=([^|]*)\|>\n(.*?)<\|end\|>\n", re.DOTALL)

#: The conversation whose texts consist of control strings.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _open(role: str) -> str:
    return f"<|turn role={quote(role, safe='')}|>\n"


def windows(turns: Iterator[tuple[str, str, int]], budget: int = BUDGET, history: int = HISTORY) -> Iterator[tuple]:
    """(window, text, fresh_from, loss, tokens) of one conversation, from its (role, text, tokens) in order.

    ``fresh_from`` is the offset in code points at which the turns that no earlier window has begin,
    ``loss`` the (start, end) offsets of the targets.
    """
    system: tuple | None = None
    held: list[tuple] = []  # history and new turns
    sums = [0]  # prefix sums of their tokens
    fresh = 0  # place of the first new turn in ``held``
    number = 0

    def room() -> int:
        return budget - (system[2] if system else 0)

    def emit() -> tuple:
        nonlocal held, sums, fresh, number
        # The longest history that fits beside the new turns.
        allowed = min(history, room() - (sums[-1] - sums[fresh]))
        begin = min(fresh, bisect_left(sums, sums[fresh] - max(0, allowed)))
        out, loss, size, fresh_from = [], [], 0, None
        repeated = [system] if system else []
        for place, (role, text, _) in enumerate(repeated + held[begin:]):
            is_system = place < len(repeated)
            new = number == 0 if is_system else begin + place - len(repeated) >= fresh
            if new and fresh_from is None:
                fresh_from = size
            head, body = _open(role), escape(text)
            if new and role == "assistant" and body:
                loss.append((size + len(head), size + len(head) + len(body)))
            out.append(f"{head}{body}<|end|>\n")
            size += len(out[-1])
        row = (number, "".join(out), size if fresh_from is None else fresh_from, loss, (system[2] if system else 0) + sums[-1] - sums[begin])
        keep = bisect_left(sums, sums[-1] - history)  # what may be the next window's history
        held, sums = held[keep:], [s - sums[keep] for s in sums[keep:]]
        fresh, number = len(held), number + 1
        return row

    for place, turn in enumerate(turns):
        if place == 0 and turn[0] == "system":
            system = turn
            continue
        # New turns end where the prefix sum passes the first new turn's by more than the room.
        if len(held) > fresh and sums[-1] + turn[2] > sums[fresh] + room():
            yield emit()
        held.append(turn)
        sums.append(sums[-1] + turn[2])
    if len(held) > fresh or (system and number == 0):
        yield emit()


def _typed(batches, fields: list[tuple], rows) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows(batches)``, whose first column has the type of the input's conv_id."""
    first = next(batches, None)
    if first is not None:
        schema = pa.schema([("conv_id", first.schema.field("conv_id").type), *fields])
        yield from batches_of(rows(chain([first], batches)), schema)


def format_windows(conversations: DataFrame, ranks: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, fresh_from, loss, tokens) of every conversation (conv_id, turn, role, text)."""
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def turns(batches) -> Iterator[tuple]:
        enc = encoding(ranks)
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                yield conv, (role or "", text or "", len(encode_text(enc, text)) + MARKS)

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = [("window", pa.int64()), ("text", pa.string()), ("fresh_from", pa.int64()), ("loss", spans), ("tokens", pa.int64())]

    def rows(batches) -> Iterator[tuple]:
        for conv, group in groupby(turns(batches), key=lambda r: r[0]):
            for number, text, fresh_from, loss, tokens in windows((turn for _, turn in group), budget, history):
                yield conv, number, text, fresh_from, [{"start": a, "end": b} for a, b in loss], tokens

    def run(batches) -> Iterator[pa.RecordBatch]:
        return _typed(batches, fields, rows)

    ordered = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, window long, text string, fresh_from long, loss array<struct<start:long,end:long>>, tokens long")


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of formatted text."""
    for found in _TURN.finditer(text):
        yield unquote(found[1]), unescape(found[2])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: turns, digests of turns and of targets, and sizes."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def each(batches) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "fresh_from", "loss")), strict=True)

    def rows(batches) -> Iterator[tuple]:
        for conv, group in groupby(each(batches), key=lambda r: r[0]):
            turns, targets = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = n_windows = 0
            for _, text, fresh_from, loss in group:
                n_windows += 1
                chars += len(text)
                for role, body in turns_of(text[fresh_from:]):
                    n_turns += 1
                    turns.update(f"{role}\n{body}\n".encode())
                for span in loss:
                    target = unescape(text[span["start"] : span["end"]])
                    loss_chars += len(target)
                    targets.update(target.encode())
            yield conv, n_turns, turns.hexdigest(), loss_chars, targets.hexdigest(), chars, n_windows

    fields = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())]

    def run(batches) -> Iterator[pa.RecordBatch]:
        return _typed(batches, fields, rows)

    ordered = formatted.select("conv_id", "window", "text", "fresh_from", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, given.schema)
    return read_back(format_windows(given.unionByName(planted), public_tokenizers.path(RANKS)))
