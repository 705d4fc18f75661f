"""Formatting conversations by a template, and reading the result back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.chat import compile_template, guard, unguard

#: Control strings of the template below; a role also guards the colon that ends it.
CONTROLS = ("###", "</turn>")
TEMPLATE = (
    "{% for m in messages %}### {{ m.role | name }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.content | guard }}{% endgeneration %}"
    "{% else %}{{ m.content | guard }}{% endif %}</turn>\n{% endfor %}"
)
FILTERS = {"guard": guard(CONTROLS), "name": guard((*CONTROLS, ":"))}

#: Characters after which a part of a conversation is put out, and of a batch of parts.
PART_CHARS = 1 << 18
BATCH_CHARS = 1 << 22

PARTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int64()),
        ("text", pa.string()),
        ("learned", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
    ]
)
PARTS_SQL = "conv_id bigint, part bigint, text string, learned array<struct<start:bigint,length:bigint>>"


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            yield from zip(*[c.to_pylist() for c in batch.slice(first, 256).columns], strict=True)


def _parts(conv_id: int | None, pieces: Iterable[tuple[str, bool]]) -> Iterator[dict]:
    texts, spans, size, part = [], [], 0, 0
    for text, learned in pieces:
        if size >= PART_CHARS:
            yield {"conv_id": conv_id, "part": part, "text": "".join(texts), "learned": spans}
            texts, spans, size, part = [], [], 0, part + 1
        if learned and text:
            spans.append({"start": size, "length": len(text)})
        texts.append(text)
        size += len(text)
    yield {"conv_id": conv_id, "part": part, "text": "".join(texts), "learned": spans}


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Conversations as text: (conv_id, part, text, learned), parts numbered from 0 and to be put together in order.

    ``turns`` has conv_id, turn, role and text; messages are in order of turn, rows of one turn by role and text. The template
    sees ``messages`` with ``role`` and ``content``. ``learned`` lists the stretches of a part, in characters, that lie between
    generation marks. A conversation is rendered while its rows stream by, so a long one costs no memory; it is put out
    in parts. Null roles and texts are empty, a null conv_id is a conversation, no turns give no rows. Other columns are not
    read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, FILTERS)
        waiting, size = [], 0
        for conv_id, rows in groupby(_rows(batches), key=itemgetter(0)):
            messages = ({"role": role, "content": text} for _, _, role, text in rows)
            for part in _parts(conv_id, render({"messages": messages})):
                waiting.append(part)
                size += len(part["text"])
                if size >= BATCH_CHARS:
                    yield pa.RecordBatch.from_pylist(waiting, PARTS)
                    waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, PARTS)

    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn"),
        F.coalesce(turns["role"], F.lit("")).alias("role"),
        F.coalesce(turns["text"], F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, PARTS_SQL)


HEAD = re.compile(r"### ((?:\\.|[^\\:])*): ", re.DOTALL)
END = re.compile(r"\\.|</turn>\n", re.DOTALL)


def read_turns(texts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a conversation formatted by TEMPLATE, from its parts in order."""
    rest = ""
    for text in texts:
        rest, at = rest + text, 0
        while head := HEAD.match(rest, at):
            end = next((m for m in END.finditer(rest, head.end()) if m[0][0] != "\\"), None)
            if end is None:
                break
            yield unguard(head[1]), unguard(rest[head.end() : end.start()])
            at = end.end()
        rest = rest[at:]
    if rest:
        raise ValueError(f"not a whole turn: {rest[:80]!r}")


DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)
DIGEST_SQL = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests per conversation of the turns and of the learned text, from parts as they leave ``format_conversations``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []
        for conv_id, rows in groupby(_rows(batches), key=itemgetter(0)):
            waiting.append({"conv_id": conv_id} | _digest(rows))
            if len(waiting) == 1024:
                yield pa.RecordBatch.from_pylist(waiting, DIGEST)
                waiting = []
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, DIGEST)

    return parts.mapInArrow(run, DIGEST_SQL)


def _digest(rows: Iterable[tuple]) -> dict:
    turns, loss = hashlib.sha256(), hashlib.sha256()
    counts = {"n_turns": 0, "loss_chars": 0, "formatted_chars": 0}

    def texts() -> Iterator[str]:
        for _, _, text, learned in rows:
            counts["formatted_chars"] += len(text)
            for span in learned:
                said = unguard(text[span["start"] : span["start"] + span["length"]])
                counts["loss_chars"] += len(said)
                loss.update(said.encode())
            yield text

    for role, text in read_turns(texts()):
        counts["n_turns"] += 1
        turns.update(f"{role}\n{text}\n".encode())
    return counts | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}
