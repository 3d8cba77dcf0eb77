"""Token ids in files of directly addressable codes: any token is read without decoding those before it.

An id is cut into chunks of WIDTH bits, lowest first. Level k holds the k-th
chunks of all ids that have one, in order, and a bitmap that tells which of them
go on; the number of ones before a place (its rank, from a directory of block
counts) is the place on the next level. Frequent ids are small numbers, so most
take one chunk.

File, little-endian: b"DACTOKEN", then 64-bit words: version, width, levels,
documents, ids, and per level entries and offsets of chunks, bitmap and ranks;
then the sections, each padded to eight bytes: document ids, a byte per document
that is 1 for a null id, starts of the documents (one more than documents), and
the levels.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .shared import forget, new_folder, written
from .words import bytes_of, mix, slices

MAGIC, VERSION = b"DACTOKEN", 1
WIDTHS = {8: np.uint8, 16: np.uint16}
#: Bits of a bitmap whose ones are counted together in the rank directory.
BLOCK = 512
#: A file is closed behind the document with which it reaches this many ids.
FILE_IDS = 1 << 22
#: Bytes of text encoded at once, and ids decoded at once when a file is read from end to end.
SLICE, READ_IDS = 1 << 24, 1 << 18
#: Kinds of pieces that are encoded as one text.
LINES = 4096
END_ID = 0
#: Tasks that read files at once, at most.
READ_TASKS = 1 << 14


# --- codes ---------------------------------------------------------------------------------------------

def cut(ids: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(chunks, continues) of every level; there is one level at least."""
    rest, out = ids.astype(np.uint32), []
    while True:
        more = rest >> np.uint32(width)
        out.append(((rest & np.uint32((1 << width) - 1)).astype(WIDTHS[width]), more > 0))
        rest = more[more > 0]
        if not len(rest):
            return out


def encode_file(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, width: int = 8) -> bytes:
    """One file of the documents' ids, which stand one after the other."""
    levels = cut(ids, width)
    starts = np.zeros(len(counts) + 1, np.uint64)
    np.cumsum(counts, out=starts[1:])
    sections = [np.array([0 if i is None else i for i in doc_ids], np.int64), np.array([i is None for i in doc_ids], np.uint8), starts]
    for chunks, more in levels:
        bits = np.zeros(-(-len(more) // BLOCK) * BLOCK, np.uint8)
        bits[:len(more)] = more
        ranks = np.zeros(len(bits) // BLOCK + 1, np.uint64)
        np.cumsum(bits.reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64), out=ranks[1:])
        sections += [chunks, np.packbits(bits, bitorder="little"), ranks]
    head = 8 * (6 + 4 * len(levels))
    places, at = [], head
    for s in sections:
        places.append(at)
        at += -(-s.nbytes // 8) * 8
    words = [VERSION, width, len(levels), len(counts), len(ids)]
    for k, (chunks, _) in enumerate(levels):
        words += [len(chunks), *places[3 + 3 * k:6 + 3 * k]]
    body = b"".join(s.tobytes() + bytes(-s.nbytes % 8) for s in sections)
    return MAGIC + np.array(words, np.uint64).tobytes() + body


class TokenFile:
    """Random access to a file through `read_at(bytes, offset)`; only what a call needs is read."""

    def __init__(self, read_at):
        self._read_at = read_at
        head = read_at(48, 0)
        if head[:8] != MAGIC:
            raise ValueError("not a file of token codes")
        version, self.width, levels, self.n_docs, self.n_ids = (int(x) for x in np.frombuffer(head, np.uint64, offset=8))
        if version != VERSION:
            raise ValueError(f"token file of version {version}")
        self.levels = self._read(np.uint64, 48, 4 * levels).reshape(levels, 4).astype(np.int64)
        self._docs = 48 + 32 * levels
        self._nulls = self._docs + 8 * self.n_docs
        self._starts = self._nulls + -(-self.n_docs // 8) * 8

    def _read(self, kind, offset: int, count: int) -> np.ndarray:
        return np.frombuffer(self._read_at(np.dtype(kind).itemsize * count, int(offset)), kind)

    @cached_property
    def doc_ids(self) -> list[int | None]:
        return [None if null else i for i, null in zip(self._read(np.int64, self._docs, self.n_docs).tolist(), self._read(np.uint8, self._nulls, self.n_docs).tolist())]

    @cached_property
    def starts(self) -> np.ndarray:
        return self._read(np.uint64, self._starts, self.n_docs + 1).astype(np.int64)

    def _rank(self, level: int, place: int) -> int:
        """Ones of a level's bitmap before `place`: one directory entry and the bits of one block."""
        _, _, bitmap, ranks = self.levels[level]
        block = place // BLOCK
        bits = np.unpackbits(self._read(np.uint8, bitmap + block * BLOCK // 8, BLOCK // 8), bitorder="little") if place % BLOCK else np.zeros(0, np.uint8)
        return int(self._read(np.uint64, ranks + 8 * block, 1)[0]) + int(bits[:place % BLOCK].sum())

    def token(self, place: int) -> int:
        """The id at a place of the file."""
        if not 0 <= place < self.n_ids:
            raise IndexError(place)
        value = 0
        for level, (_, chunks, bitmap, _) in enumerate(self.levels):
            size = self.width // 8
            value |= int(self._read(WIDTHS[self.width], chunks + size * place, 1)[0]) << self.width * level
            if not self._read(np.uint8, bitmap + place // 8, 1)[0] >> place % 8 & 1:
                break
            place = self._rank(level, place)
        return value

    def tokens(self, first: int, end: int) -> np.ndarray:
        """The ids from `first` up to before `end`: a range goes on as a range of the next level."""
        out = np.zeros(end - first, np.uint32)
        live = np.arange(end - first)
        for level, (_, chunks, bitmap, _) in enumerate(self.levels):
            if not len(live):
                break
            out[live] |= self._read(WIDTHS[self.width], chunks + self.width // 8 * first, end - first).astype(np.uint32) << np.uint32(self.width * level)
            low = first // 8
            bits = np.unpackbits(self._read(np.uint8, bitmap + low, -(-end // 8) - low), bitorder="little")[first - 8 * low:end - 8 * low].astype(bool)
            if not bits.any():
                break
            first = self._rank(level, first)
            live, end = live[bits], first + int(bits.sum())
        return out

    def document(self, k: int) -> np.ndarray:
        """All ids of the k-th document of the file, its end id included."""
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, limit: int = READ_IDS) -> Iterator[tuple[int | None, np.ndarray]]:
        """(document id, ids) of all documents in order; runs of documents are read together."""
        k = 0
        while k < self.n_docs:
            end = max(int(np.searchsorted(self.starts, self.starts[k] + limit, side="right")) - 1, k + 1)
            ids = self.tokens(int(self.starts[k]), int(self.starts[end]))
            for j in range(k, end):
                yield self.doc_ids[j], ids[self.starts[j] - self.starts[k]:self.starts[j + 1] - self.starts[k]]
            k = end


# --- tokenizer -----------------------------------------------------------------------------------------

_TOKENIZERS: dict[str, tuple] = {}
# Kinds of bytes: blank, ASCII letter, ASCII digit, other visible ASCII, apostrophe, and all that never ends or begins a piece.
_BLANK, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F], _KIND[0x20], _KIND[0x27], _KIND[48:58], _KIND[65:91], _KIND[97:123] = _MARK, _BLANK, _APOSTROPHE, _DIGIT, _LETTER, _LETTER
#: Between which kinds a byte-level tokenizer always cuts, whatever stands around them.
_CUTS = np.zeros((6, 6), bool)
_CUTS[[_LETTER, _DIGIT, _MARK, _APOSTROPHE], _BLANK] = True
_CUTS[_LETTER, [_DIGIT, _MARK, _APOSTROPHE]] = _CUTS[_DIGIT, [_LETTER, _MARK, _APOSTROPHE]] = _CUTS[_MARK, [_LETTER, _DIGIT]] = _CUTS[_APOSTROPHE, _DIGIT] = True
#: Pieces that a line break may follow without changing their ids or its own.
_SIMPLE = re.compile(r" ?(?:[!-~]|\w)+")


def _tokenizer(path: str):
    """(tokenizer, its id of a line break, strings of added tokens) once per worker; the id is None where texts are encoded in one piece."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        spec = json.loads(made.to_str())
        pre = spec.get("pre_tokenizer") or {}
        cuts = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                and spec["model"]["type"] == "BPE" and not any(spec.get(k) for k in ("truncation", "padding")) and not spec["model"].get("dropout")
                and (spec.get("post_processor") or {"type": "ByteLevel"})["type"] == "ByteLevel")
        end = made.encode("\n", add_special_tokens=False).ids
        _TOKENIZERS[path] = made, end[0] if cuts and len(end) == 1 else None, [a["content"] for a in spec.get("added_tokens", [])]
    return _TOKENIZERS[path]


def _whole(made, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = [e.ids for e in made.encode_batch_fast(texts, add_special_tokens=False)]
    count = np.fromiter(map(len, found), np.int64, len(found))
    return count, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(count.sum()))


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, which, kinds): where the pieces of all texts start, the kind of each, and a piece of every kind.

    Pieces of up to 16 bytes are told apart by their bytes as two words, which
    are compared again after sorting by one; longer ones as strings.
    """
    kind = _KIND[data]
    edge = _CUTS[kind[:-1], kind[1:]]
    # a blank behind a letter of Latin-1 (two bytes, the first C3) is no part of a run of blanks either
    edge[1:] |= (data[:-2] == 0xC3) & (kind[2:] == _BLANK)
    marks = np.zeros(len(data) + 1, bool)
    marks[1:-1] = edge
    marks[offsets] = True
    starts = np.flatnonzero(marks)
    length = np.diff(starts)
    starts = starts[:-1]
    short = np.flatnonzero(length <= 16)
    room = np.concatenate([data, np.zeros(24, np.uint8)])
    at = np.ndarray(len(data) + 16, "<u8", room, strides=(1,))
    low, high = (at[starts[short] + k] & _MASKS[np.clip(length[short] - k, 0, 8)] for k in (0, 8))
    key = mix(low ^ mix(high + length[short].astype(np.uint64)))
    _, first, which_short = np.unique(key, return_index=True, return_inverse=True)
    which = np.zeros(len(starts), np.int64)
    which[short] = which_short
    same = (low == low[first][which_short]) & (high == high[first][which_short]) & (length[short] == length[short][first][which_short])
    rest = np.concatenate([np.flatnonzero(length > 16), short[~same]])
    rest.sort()
    codes: dict[bytes, int] = {}
    held = data.tobytes() if len(rest) else b""
    which[rest] = [codes.setdefault(held[a:b], len(codes)) for a, b in zip(starts[rest].tolist(), (starts + length)[rest].tolist())]
    which[rest] += len(first)
    seen = np.zeros(len(codes), np.int64)
    seen[which[rest] - len(first)] = rest
    return starts, which, np.concatenate([short[first], seen])


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ids) of whole texts; a null text is empty.

    A byte-level tokenizer cuts every text at certain pairs of bytes before it
    merges anything, so each kind of piece between such places is encoded once,
    however often the batch holds it; the kinds are encoded as lines of a few long
    texts. Other tokenizers, and batches that hold the string of an added token, get each text in one piece.
    """
    made, end, added = _tokenizer(path)
    data, offsets = bytes_of(texts)
    raw = data.tobytes()
    if end is None or not len(data) or any(a.encode() in raw for a in added):
        return _whole(made, texts.fill_null("").to_pylist())
    starts, which, kinds = _pieces(data, offsets)
    ends = np.append(starts[1:], len(data))
    names = [raw[a:b].decode("utf-8") for a, b in zip(starts[kinds].tolist(), ends[kinds].tolist())]
    simple = np.fromiter((_SIMPLE.fullmatch(n) is not None for n in names), bool, len(names))
    size, flat = np.zeros(len(names), np.int64), [np.zeros(0, np.uint32)] * 2
    if simple.any():
        lines = [n for n, s in zip(names, simple.tolist()) if s]
        _, flat[0] = _whole(made, ["\n".join([*lines[i:i + LINES], ""]) for i in range(0, len(lines), LINES)])
        size[simple] = np.diff(np.flatnonzero(flat[0] == end), prepend=-1) - 1
        flat[0] = flat[0][flat[0] != end]
    size[~simple], flat[1] = _whole(made, [n for n, s in zip(names, simple.tolist()) if not s])
    first = np.zeros(len(names), np.int64)
    first[simple] = np.cumsum(size[simple]) - size[simple]
    first[~simple] = len(flat[0]) + np.cumsum(size[~simple]) - size[~simple]
    n = size[which]
    behind = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=behind[1:])
    place = np.arange(behind[-1]) + np.repeat(first[which] - behind[:-1], n)
    return np.diff(behind[np.searchsorted(np.append(starts, len(data)), offsets)]), np.concatenate(flat)[place]


# --- files ---------------------------------------------------------------------------------------------

def file_system(folder: str):
    """(file system, path in it) of a folder's URI or path, as tasks open it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def write_files(docs: DataFrame, folder: str, path: str, doc_id: str = "doc_id", text: str = "text", width: int = 8, file_ids: int = FILE_IDS) -> DataFrame:
    """Write all documents in ascending order of their ids; returns the manifest: name, part, seq, n_docs, n_ids, start.

    Documents are cut into ranges of ids, each a task that encodes in order and
    closes a file every `file_ids` ids, so memory depends on the longest document,
    not on the table. Null ids come first; rows of one id are ordered by a hash
    of their text, then the text. Every attempt of a task writes files of its own
    under a new name and only those in the manifest, which is written last, count:
    a task that ran twice leaves files that nobody reads. An empty table has an
    empty manifest. The folder must be one that all executors reach.
    """
    tie = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("text"), tie.alias("tie"))
    ordered = rows.repartitionByRange("doc", "tie").sortWithinPartitions("doc", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, place = file_system(folder)
        store.create_dir(place, recursive=True)
        part, seq, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex
        docs, counts, ids, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal docs, counts, ids, n, seq
            name = f"tokens-{part:06d}-{seq:06d}-{attempt}.dac"
            with store.open_output_stream(f"{place}/{name}") as out:
                out.write(encode_file(docs, np.concatenate(counts), np.concatenate(ids), width))
            done = pa.RecordBatch.from_pylist([{"name": name, "part": part, "seq": seq, "n_docs": len(docs), "n_ids": n}], schema)
            docs, counts, ids, n, seq = [], [], [], 0, seq + 1
            return done

        for batch in batches:
            for low, high in slices(batch.column(1), SLICE):
                piece = batch.slice(low, high - low)
                count, found = encode_texts(piece.column(1), path)
                whole = np.insert(found, np.cumsum(count), END_ID)
                count, names = count + 1, piece.column(0).to_pylist()
                ends = np.concatenate([[0], np.cumsum(count)])
                at = 0
                while at < len(names):
                    # up to and with the document that fills the file
                    until = min(int(np.searchsorted(ends, ends[at] + file_ids - n)), len(names))
                    until = max(until, at + 1)
                    docs += names[at:until]
                    counts.append(count[at:until])
                    ids.append(whole[ends[at]:ends[until]])
                    n += int(ends[until] - ends[at])
                    at = until
                    if n >= file_ids:
                        yield close()
        if docs:
            yield close()

    schema = pa.schema([("name", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    made = written(ordered.mapInArrow(run, "name string, part int, seq int, n_docs long, n_ids long"), "token-files")
    # one row per task, then the files of each task
    tasks = made.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = tasks.select("part", F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = made.withColumn("inner", inner).join(before, "part").select("name", "part", "seq", "n_docs", "n_ids", (F.col("before") + F.col("inner")).alias("start"))
    manifest = written(placed, "token-manifest")
    forget(made)
    return manifest


def open_file(folder: str, name: str) -> TokenFile:
    store, place = file_system(folder)
    source = store.open_input_file(f"{place}/{name}")
    return TokenFile(source.read_at)


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Files are dealt to tasks by name and read from end to end; `open_file` gives single tokens and documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = file_system(folder)
        for batch in batches:
            for name, n_docs, n_ids, start in zip(*[c.to_pylist() for c in batch.columns]):
                with store.open_input_file(f"{place}/{name}") as source:
                    file = TokenFile(source.read_at)
                    if (file.n_docs, file.n_ids) != (n_docs, n_ids):
                        raise ValueError(f"{name} is not the file that the manifest names")
                    size, crc = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
                    for k, (_, ids) in enumerate(file.documents()):
                        size[k], crc[k] = len(ids), zlib.crc32(ids.astype("<u4", copy=False))
                    yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64()), pa.array(start + np.cumsum(size) - size), pa.array(size), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row stands for a whole file, so the few bytes of the manifest must not be drawn into one task
    spread = manifest.select("name", "n_docs", "n_ids", "start").repartition(max(1, min(manifest.count(), READ_TASKS)))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", width: int = 8, file_ids: int = FILE_IDS) -> tuple[DataFrame, str]:
    """Write the files to the shared folder; (manifest, folder)."""
    folder = new_folder(docs.sparkSession, "tokens")
    return write_files(docs, folder, path, doc_id, text, width, file_ids), folder
