r"""Chat formatting from event logs.

A log has events (conv_id, message, seq, kind, role, text). It is partitioned by conversation, sorted
by message and sequence and folded in one pass that holds one message at a time:

- start opens the message and gives its role;
- delta appends its text;
- edit replaces the text so far;
- regenerate drops the text so far, and later deltas build it anew.

Messages are rendered to `<|im_start|>role\ntext<|im_end|>\n`. Inside texts and roles every `<` that
backslashes (or none) and a `|` follow gets one backslash more before the `|`, which no control
string survives and which unescaping takes back exactly. The loss mask covers the escaped text of each
assistant message. Conversations of any length stream through their task; rows of one
message are all that is held.

Null texts and roles are empty. Events that repeat a sequence number within their message are dropped (the
first by kind, role and text counts), as logs deliver at least once. Turns sort by turn, then
role, then text, nulls first; rows that repeat are turns of their own. A null conv_id is a
conversation like others. Other columns are never looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.storage import partitions

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
DELTA_CHARS = 512
_MESSAGES = "conv_id long, message long, role string, text string"
_RENDERED = "conv_id long, message long, rendered string, loss array<struct<start: int, end: int>>"
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def events(turns: DataFrame, delta_chars: int = DELTA_CHARS, revised: bool = False) -> DataFrame:
    """The log that streaming the turns would have left: a start and deltas of `delta_chars` code points for each.

    A text is cut in one pass. With `revised`, a hash of conversation and place lets two messages of three begin with a draft: one is
    taken back by a regeneration, the other by an edit that gives the first piece; the folded texts are the same.
    """
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    d = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    d = d.select("conv_id", F.row_number().over(by).cast("long").alias("message"), "role", "text")

    def event(kind: str, role: Column | None = None, text: Column | None = None) -> Column:
        parts = {"kind": F.lit(kind), "role": role, "text": text}
        return F.struct(*[(F.lit(None) if c is None else c).cast("string").alias(n) for n, c in parts.items()])

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{delta_chars}}}"), F.lit(0))
    deltas = lambda p: F.transform(p, lambda x: event("delta", text=x))
    start, draft = event("start", role=F.col("role")), event("delta", text=F.concat(F.lit("draft of "), F.col("role")))
    of = F.col("pieces")
    plain = F.concat(F.array(start), deltas(of))
    again = F.concat(F.array(start, draft, event("regenerate")), deltas(of))
    first = F.coalesce(F.get(of, F.lit(0)), F.lit(""))
    edited = F.concat(F.array(start, draft, event("edit", text=first)), deltas(F.slice(of, 2, F.greatest(F.size(of), F.lit(1)))))
    way = F.pmod(F.xxhash64("conv_id", "message"), F.lit(3)) if revised else F.lit(0)
    d = d.select("conv_id", "message", "role", pieces.alias("pieces"), way.alias("way"))
    log = F.when(F.col("way") == 1, again).when(F.col("way") == 2, edited).otherwise(plain) if revised else plain
    d = d.select("conv_id", "message", F.posexplode(log).alias("seq", "e"))
    return d.select("conv_id", "message", F.col("seq").cast("long").alias("seq"), "e.kind", "e.role", "e.text")


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, message, role, text), each conversation's messages in order within one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, role, parts, out, held = None, None, "", [], [], 0

        def batch() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["conv_id", "message", "role", "text"])

        for b in batches:
            for conv, message, number, kind, who, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (conv, message):
                    if key is not None:
                        out.append((*key, role, "".join(parts)))
                        held += len(out[-1][3])
                    key, seq, role, parts = (conv, message), None, "", []
                    if held > 4_000_000 or len(out) >= 5000:
                        yield batch()
                        out, held = [], 0
                if number is not None and number == seq:
                    continue
                seq = number
                if kind == "start":
                    role = who or ""
                elif kind == "delta":
                    parts.append(text or "")
                elif kind == "edit":
                    parts = [text or ""]
                elif kind == "regenerate":
                    parts = []
                else:
                    raise ValueError(f"unknown kind of event: {kind}")
        if key is not None:
            out.append((*key, role, "".join(parts)))
        if out:
            yield batch()

    order = ["conv_id", "message", "seq", "kind", "role", "text"]
    return log.select(*order).repartition(partitions(log.sparkSession, log), "conv_id").sortWithinPartitions(*order).mapInArrow(run, _MESSAGES)


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, message, rendered, loss): a conversation's text is its rows' `rendered` in order; loss spans are code points of the row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, loss = [], []
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                head, body = f"{OPEN}{_role(role)}\n", escape(text)
                texts.append(head + body + CLOSE)
                loss.append([{"start": len(head), "end": len(head) + len(body)}] if role == "assistant" else [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(loss, kind)], names=["conv_id", "message", "rendered", "loss"])

    return messages.mapInArrow(run, _RENDERED)


def parse(rendered: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    if not (rendered.startswith(OPEN) and rendered.endswith(CLOSE)):
        raise ValueError("not a rendered message")
    role, _, text = rendered[len(OPEN) : -len(CLOSE)].partition("\n")
    return _unrole(role), unescape(text)


def digest(rendered: DataFrame) -> DataFrame:
    """Per conversation, read back from the rendered rows as render() leaves them: conversation by conversation, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv = False, None
        turns = loss = chars = size = n = None
        for b in batches:
            out = []
            for c, text, mask in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if not started or c != conv:
                    if started:
                        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    started, conv, n, chars, size, turns, loss = True, c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, said = parse(text)
                n, size = n + 1, size + len(text)
                turns.update(f"{role}\n{said}\n".encode())
                for m in mask:
                    part = unescape(text[m["start"] : m["end"]])
                    chars += len(part)
                    loss.update(part.encode())
            yield _digests(out)
        if started:
            yield _digests([(conv, n, turns.hexdigest(), chars, loss.hexdigest(), size)])

    return rendered.mapInArrow(run, _DIGESTS)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in _DIGESTS.split(", ")])
