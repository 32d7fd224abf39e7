"""Formatting of conversations by a template that is only ever called.

A template is a function from a list of (role, text) to a string. It is called
on the successive prefixes of a conversation. Each output must begin with the
one before; what it adds is the turn's span. Where it does not begin so, the
template rewrites history, and the first turn at which it does is reported
instead of spans. The place of the text inside a turn is found the same way:
the turn is rendered with two texts of one letter each, which agree in what is
before the text and in what is after it.

Rendering every prefix takes time that grows with the square of the turns, and
nothing less will do for a template of which nothing is known: conversations
are rendered whole, each in one task. A caller that knows a template to be
``local`` says so: what it adds for a turn is then the same after whatever turns
and there is nothing before the first. Turns are then dealt by ranges of
conversation and turn, so that many tasks share a long conversation, and
rendered in blocks. That the template is local is tested for each turn, alone
and after itself, and ``NotLocal`` raised where it is not, so that neither the
blocks nor the ranges can change a result.

Defined results: a null role or text is empty; a null conversation id is one
conversation; a null turn comes first, and equal turns are in order of role and
text; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

BLOCK = 64  # turns that are rendered together
BLOCK_CHARS = 1 << 20  # characters after which a block ends

# fixed values of the format
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """``text`` without any control string, from which it can be read back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def chat_template(turns: Turns) -> str:
    """Each turn between its marks; control strings inside are escaped."""
    return "".join(
        START + escape(role).replace("\n", "\\n") + "\n" + escape(text) + END + "\n"
        for role, text in turns
    )


def parse(output: str) -> Turns:
    """The turns that ``chat_template`` made ``output`` of."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(output)]


def agreement(a: str, b: str, start: int = 0) -> int:
    """How many characters ``a`` and ``b`` begin with in common, the first
    ``start`` being known to agree."""
    low, high = start, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class NotLocal(ValueError):
    """A template was said to be local and is not."""


def check_local(template: Template, turn: tuple[str, str], added: str) -> None:
    """That ``turn`` comes out as ``added`` alone, after itself and after nothing."""
    if template([]) or template([turn]) != added or template([turn, turn]) != 2 * added:
        raise NotLocal(
            "the template looks at other turns or has an opening: format with local=False"
        )


def located(
    template: Template, turns: Turns, local: bool = False
) -> tuple[str, list[tuple[int, int, int, int]], int]:
    """The output; per turn the bounds of its span and of its text inside; and
    the first turn at which the template rewrites history, or -1. With ``local``
    ``NotLocal`` is raised instead, and also where a turn comes out otherwise
    by itself."""
    output, spans, rewritten = _located(template, turns, local)
    if local and rewritten >= 0:
        raise NotLocal(f"the template rewrites history at turn {rewritten} of a block")
    return output, spans, rewritten


def _located(
    template: Template, turns: Turns, local: bool
) -> tuple[str, list[tuple[int, int, int, int]], int]:
    before, spans = template([]), []
    for k, (role, text) in enumerate(turns):
        now = template(turns[: k + 1])
        one, other = (template([*turns[:k], (role, probe)]) for probe in "XY")
        if not (now.startswith(before) and one.startswith(before)):
            return template(turns), [], k
        if local:
            check_local(template, (role, text), now[len(before) :])
        head = agreement(one, other, len(before))
        tail = agreement(one[head:][::-1], other[head:][::-1])
        stop = len(now) - tail
        if stop < head or now[:head] != one[:head] or now[stop:] != one[len(one) - tail :]:
            return template(turns), [], k
        spans.append((len(before), len(now), head, stop))
        before = now
    return before, spans, -1


_BOUNDS = ("start", "end", "text_start", "text_end")
_SPANS = T.StructType([T.StructField("role", T.StringType())])
for _bound in _BOUNDS:
    _SPANS.add(_bound, "long")
FORMATTED = (
    T.StructType()
    .add("whole", "boolean")
    .add("n_turns", "long")
    .add("formatted", "string")
    .add("spans", T.ArrayType(_SPANS))
    .add("rewritten_at", "long")
)


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], names=schema.names
    )


def _blocks(
    batches: Iterator[pa.RecordBatch], local: bool, block: int
) -> Iterator[tuple[object, Turns, bool]]:
    """The turns of sorted rows in blocks of one conversation each, and whether
    a block is surely all of its conversation: the first and the last one of a
    task may go on in another, unless conversations are not split at all."""
    id, held, chars, alone, opening = None, [], 0, True, True
    for batch in batches:
        for value, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if held and value != id:
                yield id, held, not local or (alone and not opening)
                held, chars, alone, opening = [], 0, True, False
            elif held and local and (len(held) >= block or chars > BLOCK_CHARS):
                yield id, held, False
                held, chars, alone = [], 0, False
            id = value
            held.append((role or "", text or ""))
            chars += len(held[-1][1])
    if held:
        yield id, held, not local


def format_conversations(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    template: Template = chat_template,
    local: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Per part of a conversation its id, ``part`` (parts follow each other in
    this order), and the columns of ``FORMATTED``: ``whole`` says that it is
    known to be the only part, bounds and ``rewritten_at`` (-1 for a template
    that leaves history as it was) are counted within the part.

    A conversation is one part, rendered in one task in time that grows with the
    square of its turns. Of a ``local`` template the parts have at most ``block``
    turns, and other tasks may have other parts.
    """
    id_type = turns.schema[conversation].dataType
    schema = T.StructType([T.StructField("id", id_type), *FORMATTED.fields])
    arrow = to_arrow_schema(schema)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held = [], 0
        for id, own, whole in _blocks(batches, local, block):
            output, spans, rewritten = located(template, own, local)
            named = [dict(zip(_SPANS.names, (r, *span))) for (r, _), span in zip(own, spans)]
            done.append((id, whole, len(own), output, named, rewritten))
            held += len(output)
            if held > 1 << 24:
                yield _batch(list(zip(*done)), arrow)
                done, held = [], 0
        if done:
            yield _batch(list(zip(*done)), arrow)

    if local:
        dealt = turns.repartitionByRange(conversation, turn)
    else:
        dealt = turns.repartition(conversation)
    return (
        dealt.sortWithinPartitions(conversation, turn, role, text)
        .select(conversation, role, text)
        .mapInArrow(formatted, schema)
        .select(
            F.col("id").alias(conversation),
            F.monotonically_increasing_id().alias("part"),
            *FORMATTED.names,
        )
    )


READ_BACK = (
    T.StructType()
    .add("turns_sha256", "string")
    .add("loss_chars", "long")
    .add("loss_sha256", "string")
    .add("formatted_chars", "long")
)


class Digests:
    """What is read back from the parts of a conversation, one after another."""

    def __init__(self):
        self.n_turns = self.loss_chars = self.chars = 0
        self.rewritten_at = -1
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, n_turns: int, rewritten_at: int, output: str, spans: list, trained: str) -> None:
        for role, text in parse(output):
            self.turns.update(f"{role}\n{text}\n".encode())
        for s in spans:
            if s["role"] == trained:
                text = unescape(output[s["text_start"] : s["text_end"]])
                self.loss_chars += len(text)
                self.loss.update(text.encode())
        if rewritten_at >= 0 and self.rewritten_at < 0:
            self.rewritten_at = self.n_turns + rewritten_at
        self.n_turns += n_turns
        self.chars += len(output)

    def row(self) -> tuple:
        return (
            self.n_turns,
            self.rewritten_at,
            self.turns.hexdigest(),
            self.loss_chars,
            self.loss.hexdigest(),
            self.chars,
        )


def read_back(
    formatted: DataFrame, conversation: str = "conv_id", trained: str = "assistant"
) -> DataFrame:
    """Per conversation of ``formatted`` parts: ``n_turns``, ``rewritten_at`` and
    digests of what is read back from the output: all turns, and the text under
    the loss mask, which covers the texts of the turns of role ``trained``.

    Whole conversations are read back where they are. A digest of several parts
    has to see them in order, in one task; it holds a part at a time, and its
    time grows with the text.
    """
    id_field = T.StructField("id", formatted.schema[conversation].dataType)
    results = T.StructType().add("n_turns", "long").add("rewritten_at", "long")
    results = T.StructType([*results.fields, *READ_BACK.fields])
    part = [formatted.schema[c] for c in ("part", "whole")]
    text = [formatted.schema[c] for c in ("formatted", "spans")]
    looked = T.StructType([id_field, *part, *results.fields, *text])
    final = T.StructType([id_field, *results.fields])
    looked_arrow, final_arrow = to_arrow_schema(looked), to_arrow_schema(final)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id, part, whole, n, rewritten, output, spans in zip(
                *(batch.column(k).to_pylist() for k in range(batch.num_columns))
            ):
                if whole:
                    own = Digests()
                    own.add(n, rewritten, output, spans, trained)
                    rows.append((id, part, whole, *own.row(), None, None))
                else:
                    rows.append((id, part, whole, n, rewritten, *[None] * 4, output, spans))
            if rows:
                yield _batch(list(zip(*rows)), looked_arrow)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, open_parts = None, None
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                id, _, whole, *known, output, spans = (
                    batch.column(c)[k].as_py() for c in range(batch.num_columns)
                )
                if open_parts and (whole or id != name):
                    rows.append((name, *open_parts.row()))
                    open_parts = None
                if whole:
                    rows.append((id, *known))
                    continue
                name, open_parts = id, open_parts or Digests()
                open_parts.add(*known[:2], output, spans, trained)
            if rows:
                yield _batch(list(zip(*rows)), final_arrow)
        if open_parts:
            yield _batch([[v] for v in (name, *open_parts.row())], final_arrow)

    return (
        formatted.select(
            F.col(conversation).alias("id"),
            "part", "whole", "n_turns", "rewritten_at", "formatted", "spans",
        )
        .mapInArrow(look, looked)
        .repartition("id")
        .sortWithinPartitions("id", "part")
        .mapInArrow(together, final)
        .withColumnRenamed("id", conversation)
    )
