"""Operator 6: chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) turns to a string. Turns are rendered in growing prefixes; what a
prefix adds to the one before is the turn's span, and rendering the same turn with two probe texts shows where in the span
its text begins and ends. A template that changes what it wrote before is detected: the first place at which the output
of a prefix departs from that of the one before is reported for the turn, and spans are taken from there on.

The own template marks turns, `<|im_start|>role`, line end, text, `<|im_end|>`, line end, and escapes control strings in
roles and texts reversibly: wherever `<`, any number of backslashes and `|` follow each other, one more backslash is put in.
A role's line ends and backslashes are written as `\\n` and `\\\\`. The loss mask covers the texts of assistant turns.

Conversations are dealt by id and ordered by turn (then role and text, so ties have a defined order); nulls count as empty
texts, a null turn comes first, a null conversation id is one conversation. A template sees a conversation from its first
turn on, so a task holds one conversation and its output, which are one row. Only a template that is declared to render
each turn by itself (`per_turn`) is given parts of at most `PART_TURNS` turns, each a row, as the parts' outputs put
together are its output; then a task holds one part.
"""

from __future__ import annotations

import hashlib
import os.path
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Template = Callable[[list[tuple[str, str]]], str]

#: Turns of a part, for templates that are declared `per_turn`.
PART_TURNS = 32
ASSISTANT = "assistant"
_OPEN = re.compile(r"<(\\*)\|")
_CLOSED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def per_turn(template: Template) -> Template:
    """Declares that the template's output for turns is that of each turn alone, one after the other."""
    template.per_turn = True
    return template


@per_turn
def marked_turns(turns: list[tuple[str, str]]) -> str:
    """The own template."""
    return "".join(f"<|im_start|>{escape_role(role)}\n{escape(text)}<|im_end|>\n" for role, text in turns)


class Rendered:
    """A template's output for turns, with the span and the text span of each, and where history was rewritten."""

    def __init__(self, template: Template):
        self.template = template
        self.turns: list[tuple[str, str]] = []
        self.output = ""
        self.spans: list[tuple[int, int]] = []
        self.text_spans: list[tuple[int, int]] = []
        #: For each turn the first place that it changed in the output before it, or -1.
        self.rewrites: list[int] = []

    def add(self, role: str, text: str) -> None:
        before, turns = self.output, self.turns
        turns.append((role, text))
        self.output = out = self.template(turns)
        kept = len(before) if out.startswith(before) else len(os.path.commonprefix([before, out]))
        self.rewrites.append(-1 if kept == len(before) else kept)
        # Two probes that differ in all they have: what they share is what stands around the text.
        one, two = self.template([*turns[:-1], (role, "0")]), self.template([*turns[:-1], (role, "1")])
        start = len(os.path.commonprefix([one, two]))
        behind = len(one) - start - 1 if len(one) == len(two) else len(os.path.commonprefix([one[::-1], two[::-1]]))
        self.spans.append((kept, len(out)))
        # A template may leave a text out: then its span is empty.
        shown = one != two
        self.text_spans.append((start, len(out) - behind) if shown else (len(out), len(out)))


def render(turns: list[tuple[str, str]], template: Template = marked_turns) -> Rendered:
    rendered = Rendered(template)
    for role, text in turns:
        rendered.add(role, text)
    return rendered


def format_conversations(df: DataFrame, template: Template = marked_turns) -> DataFrame:
    """Rows (conv_id, part, formatted, turns) in order within each partition; input columns conv_id, turn, role, text.

    One row (part 0) for a conversation, unless the template is declared `per_turn`.
    turns is array<struct<start, end, text_start, text_end, loss, rewrites>>, in code points of `formatted`.
    """
    own = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_()), ("rewrites", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("turns", pa.list_(span))])

    most = PART_TURNS if getattr(template, "per_turn", False) else None

    def finished(rows: list[tuple]) -> pa.RecordBatch:
        out = [], [], [], []
        for conv, part, turns in rows:
            done = render(turns, template)
            spans = zip(turns, done.spans, done.text_spans, done.rewrites)
            listed = [{"start": a, "end": b, "text_start": c, "text_end": d, "loss": role == ASSISTANT, "rewrites": w} for (role, _), (a, b), (c, d), w in spans]
            for column, value in zip(out, (conv, part, done.output, listed)):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now = None  # [conversation, part, turns]
        held = 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if now is None or conv != now[0] or len(now[2]) == most:
                    if now is not None:
                        rows.append(tuple(now))
                        held += len(now[2])
                    now = [conv, 0 if now is None or conv != now[0] else now[1] + 1, []]
                    if len(rows) >= 256 or held >= 256 * PART_TURNS:
                        yield finished(rows)
                        rows, held = [], 0
                now[2].append((role, text))
        if now is not None:
            rows.append(tuple(now))
        if rows:
            yield finished(rows)

    turn = "struct<start: long, end: long, text_start: long, text_end: long, loss: boolean, rewrites: long>"
    return ordered.mapInArrow(run, f"conv_id long, part long, formatted string, turns array<{turn}>")


def read_turn(formatted: str, turn: dict) -> tuple[str, str]:
    """(role, text) of a turn of the own template, read from the output."""
    header = formatted[turn["start"] : turn["text_start"]]
    role = header[len("<|im_start|>") : -1]
    return unescape_role(role), unescape(formatted[turn["text_start"] : turn["text_end"]])


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation, read back from the output: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, rewritten).

    The parts of a conversation follow each other in one partition, so its digests are carried from row to row; none of its
    texts is held.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*((c, n, h.hexdigest(), k, g.hexdigest(), f, w) for c, n, h, k, g, f, w in rows)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        done: list[list] = []
        now: list | None = None
        for batch in batches:
            for conv, formatted, turns in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if now is None or conv != now[0]:
                    if now is not None:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    if len(done) >= 4096:
                        yield closed(done)
                        done = []
                now[5] += len(formatted)
                for turn in turns:
                    role, text = read_turn(formatted, turn)
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    now[6] += turn["rewrites"] >= 0
                    if turn["loss"]:
                        now[3] += len(text)
                        now[4].update(text.encode("utf-8", "surrogatepass"))
        if now is not None:
            done.append(now)
        if done:
            yield closed(done)

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten long")
