"""Chat formatting: a visitor flattens typed content parts into text with ordered placeholders.

Turns are formatted one by one where they lie. A conversation is its turns in
order; reading it back streams over sorted turns with constant memory.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import with_result

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that a tokenizer or another template reads as control; texts never show them unbroken.
CONTROLS = (OPEN, CLOSE, "<|", "|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
            "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>")
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
_BREAKS = re.compile("|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in sorted(set(CONTROLS))))
_TURN = re.compile(rf"{re.escape(OPEN)}((?:[^\\\n]|\\.)*)\n(.*?){re.escape(CLOSE)}\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    r"""Double each backslash, then put one after the first character of every control string."""
    return _BREAKS.sub(r"\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class PartVisitor:
    """Visits the parts of a turn in order: collects text, attachments and the tokens that placeholders expand to."""

    def __init__(self, tile: int = 512, tile_tokens: int = 170, image_tokens: int = 85, audio_tokens: float = 25.0, page_tokens: int = 800):
        self.tile, self.tile_tokens, self.image_tokens = tile, tile_tokens, image_tokens
        self.audio_tokens, self.page_tokens = audio_tokens, page_tokens
        self.pieces: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown content part {kind!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil((part.get("width") or 0) / self.tile) * math.ceil((part.get("height") or 0) / self.tile)
        self._attach("image", part, self.image_tokens + self.tile_tokens * tiles)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * self.audio_tokens))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, self.page_tokens * (part.get("pages") or 0))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.pieces.append(f"<|{kind}|>")
        self.attachments.append({"ordinal": len(self.attachments), "kind": kind, "ref": part.get("ref"), "tokens": int(tokens)})


def format_turns(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str | None = "text",
                 parts: str | None = None, trained: Iterable[str] = ("assistant",), **expand) -> DataFrame:
    """One row per message: `segment`, `loss_spans` (character ranges of the segment to train on), `attachments`
    (ordinal within the turn, kind, ref, expanded tokens) and `expanded_tokens`, their sum.

    Content is the array column `parts` (see PARTS) or, where that is null or
    not given, one text part. Null texts and roles are empty; an unknown part
    type is an error. Loss covers the text between role and end mark of
    `trained` roles, placeholders left out. Every row gives a segment, repeated
    rows too; other columns stay, those named like a result are replaced.
    """
    chosen = frozenset(trained)
    attached = pa.list_(pa.struct([("ordinal", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
    spans = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
    kind = pa.struct([("segment", pa.string()), ("loss_spans", spans), ("attachments", attached), ("expanded_tokens", pa.int64())])

    @F.arrow_udf("segment string, loss_spans array<struct<first:long,past:long>>, attachments array<struct<ordinal:long,kind:string,ref:string,tokens:long>>, expanded_tokens long")
    def flatten(roles: pa.Array, contents: pa.Array) -> pa.Array:
        rows = []
        for who, content in zip(roles.to_pylist(), contents.to_pylist()):
            visitor = PartVisitor(**expand)
            for part in content or ():
                visitor.visit(part or {})
            head = OPEN + escape(who or "").replace("\n", "\\\n") + "\n"
            at, loss = len(head), []
            for piece in visitor.pieces:
                if (who or "") in chosen and piece and piece not in ("<|image|>", "<|audio|>", "<|document|>"):
                    loss.append({"first": at, "past": at + len(piece)})
                at += len(piece)
            rows.append({"segment": head + "".join(visitor.pieces) + CLOSE + "\n", "loss_spans": loss, "attachments": visitor.attachments,
                         "expanded_tokens": sum(a["tokens"] for a in visitor.attachments)})
        return pa.array(rows, kind)

    plain = F.array(F.struct(F.lit("text").alias("type"), (F.col(text) if text else F.lit(None)).cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
                             F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))
    content = F.coalesce(F.col(parts).cast(PARTS), plain.cast(PARTS)) if parts else plain.cast(PARTS)
    done = with_result(messages, "_turn", flatten(F.col(role).cast("string"), content))
    for name in ("segment", "loss_spans", "attachments", "expanded_tokens"):
        done = with_result(done, name, F.col(f"_turn.{name}"))
    return done.drop("_turn")


def conversations(formatted: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Segments of each conversation together and in order of turn; ties by segment, so reruns agree."""
    return formatted.repartition(F.col(conv)).sortWithinPartitions(F.col(conv), F.col(turn), F.col("segment"))


def parse(segments: str) -> list[tuple[str, str]]:
    """(role, escaped content) of every turn of a formatted text; anything between turns is an error."""
    turns, at = [], 0
    for m in _TURN.finditer(segments):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), m[2]))
        at = m.end()
    if at != len(segments):
        raise ValueError(f"not a formatted conversation at character {at}")
    return turns


def read_back(formatted: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Digests of every conversation, parsed from its formatted text and loss spans.

    conv, n_turns, turns_sha256 (role, newline, text, newline per turn),
    loss_chars and loss_sha256 (unescaped text under the mask), formatted_chars,
    attachments and expanded_tokens. A null conversation id is one conversation.
    Segments stream through in order: state is one pair of running hashes,
    whatever the length of a conversation. An empty table gives no rows.
    """
    out = pa.schema([("conv", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("attachments", pa.int64()), ("expanded_tokens", pa.int64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: list | None = None
        done: list[dict] = []

        def close():
            key, turns, loss, n, loss_chars, chars, attached, tokens = current
            done.append({"conv": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(),
                         "formatted_chars": chars, "attachments": attached, "expanded_tokens": tokens})

        for batch in batches:
            for key, segment, spans, attached, tokens in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if current is None or current[0] != key:
                    if current is not None:
                        close()
                    current = [key, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0, 0]
                for role, content in parse(segment):
                    current[1].update(f"{role}\n{unescape(content)}\n".encode())
                    current[3] += 1
                for span in spans:
                    plain = unescape(segment[span["first"]:span["past"]])
                    current[2].update(plain.encode())
                    current[4] += len(plain)
                current[5] += len(segment)
                current[6] += attached
                current[7] += tokens
            if done:
                yield pa.RecordBatch.from_pylist(done, out)
                done = []
        if current is not None:
            close()
            yield pa.RecordBatch.from_pylist(done, out)

    ordered = conversations(formatted, conv, turn).select(F.col(conv).cast("long").alias("conv"), "segment", "loss_spans", F.size("attachments").cast("long").alias("attached"), "expanded_tokens")
    result = ordered.mapInArrow(fold, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachments long, expanded_tokens long")
    return result.withColumnRenamed("conv", conv)
