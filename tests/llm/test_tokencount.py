import random

import numpy as np
import public_tokenizers
import tiktoken
import pytest

from mirepoix.llm import packing, tokencount

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_scan_of_files_equals_a_plain_one(spark, tmp_path, block):
    rng, want = random.Random(block), set()
    for f in range(5):
        ids, start, ordinal = [rng.choice([9, 9, 9, 4, 0]) for _ in range([0, 1, 50, 333, 40][f])] + ([9] * 60 if f == 4 else []), 0, 0
        path = tmp_path / f"t{f}.bin"
        np.array(ids, dtype="<u2").tofile(path)
        for i, x in enumerate(ids):
            if x == 0:
                want.add((f, ordinal, start, i - start))
                start, ordinal = i + 1, ordinal + 1
        if start < len(ids):
            want.add((f, ordinal, start, len(ids) - start))
    blocks = tokencount.read_blocks(spark, f"{tmp_path}/*.bin", block_tokens=block)
    rows = tokencount.document_lengths(blocks, end_id=0, run=4).collect()
    assert len(rows) == len(want)
    assert {(int(r.file[-5]), r.ordinal, r.start, r.n_tokens) for r in rows} == want


def test_counts_of_documents(spark):
    texts = [None, "", "one two", "<|endoftext|> is text here", "é " * 3000, "one two"]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(None, "x", 1)], "doc_id long, text string, start int").repartition(3)
    rows = tokencount.document_token_counts(docs, RANKS, block_tokens=64).collect()
    plain = packing.byte_encoding(RANKS)
    assert isinstance(plain, tiktoken.Encoding)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in rows) == [(-1, 1), *((i, len(plain.encode_ordinary(t or ""))) for i, t in enumerate(texts))]
    assert tokencount.document_token_counts(docs.limit(0), RANKS).collect() == []


def test_ranges_of_files_with_odd_names(spark, tmp_path):
    want = {}
    for name, n in (("a b%41.bin", 1000), ("ü.bin", 64 * 5), ("c.bin", 1), ("none.bin", 0)):
        want[name] = np.arange(n, dtype="<u2").tobytes()
        (tmp_path / name).write_bytes(want[name])
    blocks = tokencount.read_blocks(spark, f"{tmp_path}/*.bin", block_tokens=5, run=3)
    assert blocks.rdd.getNumPartitions() > 1
    got = {name: b"" for name in want}
    for r in blocks.orderBy("file", "block").collect():
        assert 0 < len(r.payload) <= 10
        got[r.file.rsplit("/", 1)[1]] += r.payload
    assert got == want


def test_repeated_ids_and_texts_of_megabytes_in_one_batch(spark):
    texts = ["word é " * 400_000, "a", "b c " * 700_000, "a", None]
    docs = spark.createDataFrame(list(zip([5, 5, 5, 5, 6], texts)), "doc_id long, text string").coalesce(1)
    rows = tokencount.document_token_counts(docs, RANKS).collect()
    plain = packing.byte_encoding(RANKS)
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((i, len(plain.encode_ordinary(t or ""))) for i, t in zip([5, 5, 5, 5, 6], texts))
