"""Chat formatting of typed content parts, and reading the formatted text back.

A turn is formatted as ``<|turn|>role``, a line end, its content, ``<|end|>`` and a line end. Content is a list
of parts; a visitor turns text into escaped text and every image, audio clip and document into a placeholder
such as ``<|image|>``, and notes where the attachment belongs and how many tokens it expands to. Inside roles
and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|`` (in roles also a line end ``\\n``), so that no text
can hold a control string and the way back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outletry.llm.shipping import ship

TURN, END = "<|turn|>", "<|end|>\n"
LEARNED_ROLE = "assistant"
#: Expanded sizes: an image has a token per square of so many pixels, audio so many a second, a document
#: so many a page.
IMAGE_SQUARE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512

PARTS_TYPE = (
    "array<struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
)
SEGMENTS = (
    "conv_id long, turn long, role string, formatted string, loss_start long, loss_end long, n_tokens long, "
    "attachments array<struct<kind: string, ref: string, place: long, n_tokens: long>>"
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


@dataclass
class Flattener:
    """Visits the parts of one turn in order. A part of unknown kind is visited as a document."""

    out: list[str] = field(default_factory=list)
    length: int = 0
    n_tokens: int = 0
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_document)(part)

    def add(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.n_tokens += len(text.split())
        self.add(escape(text))

    def attach(self, kind: str, part: dict, n_tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "place": self.length, "n_tokens": n_tokens})
        self.n_tokens += n_tokens
        self.add(f"<|{kind}|>")

    def visit_image(self, part: dict) -> None:
        width, height = part.get("width") or 0, part.get("height") or 0
        self.attach("image", part, -(-width // IMAGE_SQUARE) * -(-height // IMAGE_SQUARE))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, int(-(-(part.get("seconds") or 0.0) * AUDIO_RATE // 1)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * PAGE_TOKENS)


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, int, int, Flattener]:
    """(formatted turn, start and end of its content in it, what the visitor gathered)."""
    head = f"{TURN}{escape(role or '').replace(chr(10), chr(92) + 'n')}\n"
    flat = Flattener()
    for part in parts or []:
        flat.visit(part or {})
    return head + "".join(flat.out) + END, len(head), len(head) + flat.length, flat


def _format(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            text, start, end, flat = format_turn(row["role"], row["parts"])
            learned = row["role"] == LEARNED_ROLE
            rows.append(
                {
                    "conv_id": row["conv_id"], "turn": row["turn"], "role": row["role"] or "", "formatted": text,
                    "loss_start": start if learned else None, "loss_end": end if learned else None,
                    "n_tokens": flat.n_tokens,
                    "attachments": [a | {"place": start + a["place"]} for a in flat.attachments],
                }
            )
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow_schema() -> pa.Schema:
    attachment = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int64()), ("n_tokens", pa.int64())])
    return pa.schema(
        [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()),
         ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("n_tokens", pa.int64()),
         ("attachments", pa.list_(attachment))]
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """One formatted segment per row of ``turns`` (conv_id, turn, role, parts or text).

    The segments of a conversation, put together in the order of turn, are its formatted text; no
    conversation is ever gathered to make it. ``loss_start`` and ``loss_end`` bound the content of assistant
    turns in their segment (code points), null for others. ``attachments`` have kind, ref, place of the
    placeholder in the segment, and expanded tokens; ``n_tokens`` adds those to the words of the texts.

    * A null role is the empty role. Null parts, a null list and a null text are empty content.
    * Rows with a null conv_id form one conversation. Repeated rows are turns of their own.
    * Extra columns are ignored; an empty table gives an empty result.
    """
    ship(turns.sparkSession)
    if "parts" not in turns.columns:
        text = F.named_struct(F.lit("kind"), F.lit("text"), F.lit("text"), F.col("text").cast("string"))
        turns = turns.withColumn("parts", F.array(text))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), "parts",
    )
    return rows.mapInArrow(lambda b: _format(b, _arrow_schema()), SEGMENTS)


_MARK = re.compile(re.escape(TURN) + r"([^\n]*)\n|" + re.escape(END))


class ChatReader:
    """Reads one formatted conversation piece by piece and keeps digests, not text."""

    def __init__(self) -> None:
        self.rest, self.role = "", None
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str) -> None:
        self.formatted_chars += len(piece)
        text, at = self.rest + piece, 0
        while True:
            if self.role is None:
                mark = _MARK.match(text, at)
                if not mark:
                    break
                self.role, at = unescape(mark[1]), mark.end()
            end = text.find(END, at)
            if end < 0:
                break
            self._turn(unescape(re.sub(r"<\|[a-z]+\|>", "", text[at:end])))
            at, self.role = end + len(END), None
        self.rest = text[at:]

    def _turn(self, content: str) -> None:
        self.n_turns += 1
        self.turns.update(f"{self.role}\n{content}\n".encode("utf-8", "surrogatepass"))
        if self.role == LEARNED_ROLE:
            self.loss_chars += len(content)
            self.loss.update(content.encode("utf-8", "surrogatepass"))

    def result(self) -> tuple:
        if self.rest or self.role is not None:
            raise ValueError("the formatted text ends inside a turn")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, conv, done = None, None, []

    def flush():
        columns = list(zip(*done, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=[x.split()[0] for x in _READ.split(", ")],
        )

    for batch in batches:
        for this, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if reader is None or this != conv:
                if reader is not None:
                    done.append((conv, *reader.result()))
                reader, conv = ChatReader(), this
            reader.feed(text)
        if len(done) >= 1000:
            yield flush()
            done = []
    if reader is not None:
        done.append((conv, *reader.result()))
    if done:
        yield flush()


def read_chats(segments: DataFrame) -> DataFrame:
    """Digests of every conversation, parsed back from its formatted text.

    Segments stream through a reader in the order of turn (equal or null turns by role, then text), so a
    conversation of any length needs no more memory than its longest turn. Its digest is a chain over
    its turns; that alone is why one conversation stays in one task.
    """
    ship(segments.sparkSession)
    rows = segments.select("conv_id", "formatted", "turn", "role").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return rows.select("conv_id", "formatted").mapInArrow(_read, _READ)
