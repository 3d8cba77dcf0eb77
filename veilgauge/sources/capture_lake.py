"""Folders of capture files to a frame table, one task per file.

Spark's binaryFile source lists and distributes the files; a generator walks
the records of each and emits Arrow batches of bounded size. A capture is not
splittable, so sensors should rotate files (hundreds of MB at most).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCHEMA = "capture string, frame bigint, ts_us bigint, linktype int, frame_bytes binary, clipped boolean, read_error string"
SUFFIXES = "*.{pcap,pcapng,cap}"
MAX_SNAPLEN = 262_144
BATCH = 10_000
# fixed values: file magics -> (byte order, fractions per second)
CLASSIC = {b"\xa1\xb2\xc3\xd4": (">", 10 ** 6), b"\xd4\xc3\xb2\xa1": ("<", 10 ** 6), b"\xa1\xb2\x3c\x4d": (">", 10 ** 9), b"\x4d\x3c\xb2\xa1": ("<", 10 ** 9)}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
ORDER_MAGIC = 0x1A2B3C4D


class Unreadable(Exception):
    """The rest of a file cannot be read; rows before it stand."""


def classic_records(data: bytes, max_snaplen: int) -> Iterator[tuple]:
    """(ts_us, linktype, bytes, clipped) of a classic capture; an impossible record is an error."""
    order, per_second = CLASSIC[data[:4]]
    if len(data) < 24:
        raise Unreadable("file header cut short")
    link = struct.unpack_from(order + "I", data, 20)[0] & 0x0FFFFFFF
    at = 24
    head = struct.Struct(order + "IIII")
    while at + 16 <= len(data):
        sec, frac, kept, full = head.unpack_from(data, at)
        at += 16
        if kept > max_snaplen:
            raise Unreadable(f"record of {kept} bytes at byte {at - 16}")
        if at + kept > len(data):
            raise Unreadable(f"record cut short at byte {at - 16}")
        yield sec * 10 ** 6 + frac * 10 ** 6 // per_second, link, data[at:at + kept], full > kept
        at += kept


def tick_of(options: bytes, order: str) -> int:
    """Ticks per second from an interface's options, microseconds by default."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size >= 1 and at + 4 < len(options):
            raw = options[at + 4]
            return 2 ** (raw & 0x7F) if raw & 0x80 else 10 ** raw
        at += 4 + (size + 3) // 4 * 4
    return 10 ** 6


def block_records(data: bytes, max_snaplen: int) -> Iterator[tuple]:
    """Records of a block-structured (pcapng) capture. Blocks whose two lengths differ are skipped.

    Packets of an interface that no block declares are Ethernet with microseconds.
    """
    order, at = "<", 0
    interfaces: list[tuple[int, int]] = []
    while at + 12 <= len(data):
        kind = struct.unpack_from("<I", data, at)[0]
        if kind == SECTION:
            order = "<" if struct.unpack_from("<I", data, at + 8)[0] == ORDER_MAGIC else ">"
            interfaces = []
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or size % 4 or at + size > len(data):
            raise Unreadable(f"block of {size} bytes at byte {at}")
        body = data[at + 8:at + size - 4]
        trailer = struct.unpack_from(order + "I", data, at + size - 4)[0]
        at += size
        if trailer != size:
            continue
        if kind == INTERFACE and len(body) >= 8:
            interfaces.append((struct.unpack_from(order + "H", body, 0)[0], tick_of(body[8:], order)))
        elif kind == ENHANCED and len(body) >= 20:
            face, high, low, kept, full = struct.unpack_from(order + "IIIII", body, 0)
            if kept <= max_snaplen and 20 + kept <= len(body):
                link, ticks = interfaces[face] if face < len(interfaces) else (1, 10 ** 6)
                yield ((high << 32) + low) * 10 ** 6 // ticks, link, body[20:20 + kept], full > kept
        elif kind == SIMPLE and len(body) >= 4:
            full = struct.unpack_from(order + "I", body, 0)[0]
            kept = min(full, len(body) - 4)
            if kept <= max_snaplen:
                yield 0, interfaces[0][0] if interfaces else 1, body[4:4 + kept], full > kept


def records(data: bytes, max_snaplen: int = MAX_SNAPLEN) -> Iterator[tuple]:
    if data[:4] in CLASSIC:
        return classic_records(data, max_snaplen)
    if data[:4] == b"\x0a\x0d\x0d\x0a":
        return block_records(data, max_snaplen)
    raise Unreadable("not a capture file" if data else "empty file")


def capture_name(path: str) -> Column:
    """A file's path below the folder that was read, so equal names in two folders stay two captures."""
    root = path.rstrip("/").split("://")[-1].split(":")[-1]
    inside = F.regexp_extract("path", "^.*?" + re.escape(root) + "/(.+)$", 1)
    return F.when(inside != "", inside).otherwise(F.element_at(F.split("path", "/"), -1))


def read_captures(spark: SparkSession, path: str, max_snaplen: int = MAX_SNAPLEN) -> DataFrame:
    """Every frame of every capture under `path`; a file that breaks off adds a row with read_error and no frame."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", SUFFIXES).option("recursiveFileLookup", "true").load(path)
    named = files.select(capture_name(path).alias("capture"), "content")

    def job(batches):
        columns = ["capture", "frame", "ts_us", "linktype", "frame_bytes", "clipped", "read_error"]

        def rows_of(capture, content):
            number = 0
            try:
                for number, r in enumerate(records(content, max_snaplen), start=1):
                    yield (capture, number, *r, None)
            except (Unreadable, struct.error) as e:
                yield (capture, number + 1, None, None, None, None, str(e))

        def frame(rows):
            out = pd.DataFrame(rows, columns=columns)
            out["ts_us"], out["linktype"] = out["ts_us"].astype("Int64"), out["linktype"].astype("Int32")
            return out

        for batch in batches:
            for capture, content in zip(batch["capture"], batch["content"]):
                rows = []
                for row in rows_of(capture, bytes(content)):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    # files are packed into tasks by size (spark.sql.files.maxPartitionBytes), no shuffle of content
    return named.mapInPandas(job, SCHEMA)


def list_captures(spark: SparkSession, path: str) -> DataFrame:
    """Name and size of every capture, without reading content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", SUFFIXES).option("recursiveFileLookup", "true").load(path)
    return files.select(capture_name(path).alias("name"), F.col("length").alias("bytes")).orderBy("name")
