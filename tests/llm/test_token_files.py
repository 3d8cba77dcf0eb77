import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilgauge.llm import queries, token_files as T

from .rows import DOCS, awkward

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(texts, path=PATH):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    return [made.encode(t or "", add_special_tokens=False).ids for t in texts]


def memory_file(raw, seen=None):
    def read_at(n, at):
        if seen is not None:
            seen.append(n)
        return raw[at:at + n]

    return T.TokenFile(read_at)


@pytest.mark.parametrize("width", [8, 16])
def test_any_token_and_any_range(width):
    r = np.random.default_rng(width)
    ids = np.where(r.random(5000) < 0.7, r.integers(0, 256, 5000), r.integers(0, 1 << 32, 5000)).astype(np.uint32)
    ids[1000:2000] = 7  # a block of the bitmap without a one
    counts = np.array([0, 1, 4000, 0, 999], np.int64)
    file = memory_file(T.encode_file([1, None, -5, 1 << 60, 2], counts, ids, width))
    assert [file.token(i) for i in range(len(ids))] == ids.tolist()
    for a, b in [(0, 5000), (0, 0), (511, 513), (512, 1024), (1, 4999), (1500, 1501), (4999, 5000), (5000, 5000)]:
        assert file.tokens(a, b).tolist() == ids[a:b].tolist()
    assert file.doc_ids == [1, None, -5, 1 << 60, 2] and [len(file.document(k)) for k in range(5)] == counts.tolist()
    assert np.concatenate([d for _, d in file.documents(limit=100)]).tolist() == ids.tolist()
    with pytest.raises(IndexError):
        file.token(5000)


def test_a_token_costs_a_bounded_read():
    ids = np.arange(1 << 18, dtype=np.uint32)
    seen = []
    file = memory_file(T.encode_file([1], np.array([len(ids)]), ids), seen)
    seen.clear()
    assert file.token(200_000) == 200_000 and sum(seen) < 300


def test_not_a_token_file():
    with pytest.raises(ValueError):
        memory_file(b"something else" * 9)


def test_parts_give_the_ids_of_whole_texts():
    r = random.Random(5)
    letters = ["a", "B", "é", "'s", "'", " ", " ", "  ", "\n", "\t", " ", " ", "7", "12", "!", "...", "日本", "\U0001f600", "<|endoftext|>", "\x00", "\x7f", "don't", "\r\n", "́"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(3000)] + [None, "", " ", "x ", " x", "word " * 1000]
    count, ids = T.encode_texts(pa.array(texts), PATH)
    want = plain(texts)
    assert count.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_a_tokenizer_of_another_kind_gets_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Some words, and more", None, "", "x  y"]
    count, ids = T.encode_texts(pa.array(texts), path)
    want = plain(texts, path)
    assert count.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def expected(rows):
    """(doc_id, n_tokens, crc) with start, in order of ids; rows of one id may stand in any order."""
    coded = [(i, [*ids, 0]) for (i, *_), ids in zip(rows, plain([r[1] for r in rows]))]
    return sorted(((i is not None, i or 0), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in coded)


def verify(got, rows):
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.ids_crc32) for r in got) == expected(rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)


@pytest.mark.parametrize("file_ids", [1, 500, 1 << 20])
def test_awkward_rows(spark, file_ids):
    rows = awkward()
    docs = spark.createDataFrame(rows, DOCS).withColumn("doc", F.lit(1)).withColumn("tie", F.lit("t")).withColumn("name", F.lit("n"))
    manifest, folder = T.tokenize(docs, PATH, file_ids=file_ids)
    verify(T.read_documents(manifest, folder).collect(), rows)
    if file_ids == 1:
        assert manifest.count() == len(rows)
    first = manifest.orderBy("start").first()
    file = T.open_file(folder, first["name"])
    assert file.token(0) == file.document(0)[0]


def test_query_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    verify(queries.QUERIES["op12_token_files"](spark, "/root/testdata/sf0.001").collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_files_of_a_lost_attempt_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    manifest, folder = T.tokenize(docs, PATH)
    store, place = T.file_system(folder)
    with store.open_output_stream(f"{place}/tokens-000000-000000-other.dac") as out:
        out.write(b"broken")
    assert T.read_documents(manifest, folder).count() == 20


def test_no_rows(spark):
    manifest, folder = T.tokenize(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert manifest.count() == 0 and T.read_documents(manifest, folder).collect() == []
