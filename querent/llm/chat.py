r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all preceding turns of its conversation are the context
and only that reply is trainable. Turns after the last reply, and conversations without a reply,
form one example with nothing trainable, so that no text is lost.

Template: a turn is ``<s>[ROLE]`` + role + ``[/ROLE]`` + text + ``</s>``. The texts' own ``<``, ``[``
and ``\`` are escaped by a leading ``\`` only where they could be read as a mark: ``\`` always, ``<`` before
``s>`` or ``/s>``, ``[`` before ``ROLE]`` or ``/ROLE]`` (and ``INST``/``SYS`` marks of common models), so
formatted text holds a mark only where the template put one, and unescaping restores every text.
Roles are escaped alike.

Cases: null text or role is empty; rows of equal turn number are ordered by role, then text, and
repeated rows are repeated turns; a null turn number comes first; a null conv_id is a conversation
of its own; an empty table gives no rows; extra columns are dropped. One example holds one prefix,
as the method asks, so a conversation of n turns gives text in the order of n squared; the prefix
is built once and rows stream out one by one, so memory holds one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm.common import ship, small_batches

BEGIN, ROLE_END, END = "<s>[ROLE]", "[/ROLE]", "</s>"
_CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?(?:ROLE|INST|SYS)\])|<(?=</?SYS>>)")
_PLAIN = re.compile(r"\\(.)", re.S)

EXAMPLE = "conv_id long, example long, n_context long, formatted string, mask array<struct<begin:int,end:int>>"


def escape(text: str | None) -> str:
    """A text in which no mark of the template can be read."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text or "")


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


def turn(role: str | None, text: str | None) -> tuple[str, str]:
    """Head and body (with its end mark) of one formatted turn."""
    return f"{BEGIN}{escape(role)}{ROLE_END}", escape(text) + END


def find(mark: str, formatted: str, at: int) -> int:
    """Place of the next unescaped mark: one that an even run of backslashes, or none, precedes."""
    while True:
        end = formatted.index(mark, at)
        k = end
        while k > 0 and formatted[k - 1] == "\\":
            k -= 1
        if (end - k) % 2 == 0:
            return end
        at = end + 1


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text and the escaped text's span of each turn of a formatted string."""
    out, at = [], 0
    while at < len(formatted):
        head = find(ROLE_END, formatted, at + len(BEGIN))
        begin = head + len(ROLE_END)
        end = find(END, formatted, begin)
        out.append((unescape(formatted[at + len(BEGIN) : head]), unescape(formatted[begin:end]), begin, end))
        at = end + len(END)
    return out


def examples(turns: list[tuple[str | None, str | None]]) -> Iterator[tuple[int, str, list[tuple[int, int]]]]:
    """For each example: number of context turns, formatted text, spans under the loss mask."""
    prefix, last = "", -1
    for i, (role, text) in enumerate(turns):
        head, body = turn(role, text)
        begin = len(prefix) + len(head)
        prefix = prefix + head + body
        if role == "assistant":
            last = i
            yield i, prefix, [(begin, len(prefix) - len(END))]
    if last < len(turns) - 1:
        yield len(turns), prefix, []


def ordered(conversations: DataFrame) -> DataFrame:
    """One row a conversation, its turns in order. A conversation is the unit of the format."""
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def expand(conversations: DataFrame) -> DataFrame:
    """Examples of all conversations: ``conv_id, example, n_context, formatted, mask``."""
    ship(conversations.sparkSession)
    small_batches(conversations.sparkSession)

    def run(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_context", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])
        rows, size = [], 0
        for b in batches:
            for r in b.to_pylist():
                for k, (n, text, mask) in enumerate(examples([(t["role"], t["text"]) for t in r["turns"]])):
                    rows.append({"conv_id": r["conv_id"], "example": k, "n_context": n, "formatted": text, "mask": [{"begin": a, "end": e} for a, e in mask]})
                    size += len(text)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return ordered(conversations).mapInArrow(run, EXAMPLE)


def read_back(made: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted examples alone.

    Turns come from the longest example, trained texts from every example's mask in order.
    ``formatted_chars`` counts the characters of all examples of the conversation."""
    ship(made.sparkSession)
    # each example is read where it stands; only spans under the mask and the longest text travel on
    trained = F.expr("transform(mask, m -> substring(formatted, m.begin + 1, m.end - m.begin))")
    parts = made.groupBy("conv_id").agg(
        F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("example", trained.alias("texts")))).alias("trained"),
        F.max_by("formatted", "example").alias("formatted"),
    )

    def run(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for b in batches:
            rows = []
            for r in b.to_pylist():
                turns, all_turns, loss, n = parse(r["formatted"]), hashlib.sha256(), hashlib.sha256(), 0
                for role, text, _, _ in turns:
                    all_turns.update(f"{role}\n{text}\n".encode())
                for e in r["trained"]:
                    for t in e["texts"]:
                        t = unescape(t)
                        n += len(t)
                        loss.update(t.encode())
                rows.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": all_turns.hexdigest(), "loss_chars": n, "loss_sha256": loss.hexdigest(), "formatted_chars": r["formatted_chars"]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
