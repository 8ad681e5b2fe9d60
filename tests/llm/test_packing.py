import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mirepoix.llm import packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize(("open_bins", "waste"), [(256, 0.05), (4, 0.2)])
def test_pieces_equal_the_library_and_fill_sequences(spark, open_bins, waste):
    rng = random.Random(1)
    texts = [None, "", "<|endoftext|>a", "x " * 9000, "é\n\n\n  ü 'll 12345"] + [" ".join(rng.choice(["the", "and", "weary", "é"]) for _ in range(rng.randint(0, 900))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, offset int").repartition(7)
    rows = packing.packed_digests(docs, RANKS, open_bins=open_bins).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    total = 0
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        total += len(ids)
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 1024)))
        assert own[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(own, own[1:]))
        assert own[-1].start + own[-1].length == len(ids) and all(r.length == 1024 for r in own[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_sequence) <= (1 + waste) * total / 1024 + 1


def test_open_bins_take_the_tightest_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.put(6) == (0, 0, [])
    assert bins.put(7) == (1, 0, [])
    assert bins.put(3) == (1, 7, [1])
    assert bins.put(5) == (2, 0, [])
    assert bins.put(9) == (3, 0, [0])
    assert bins.put(10) == (4, 0, [4])
    assert bins.put(1) == (3, 9, [3])


def test_pack_keeps_columns_and_refuses_what_does_not_fit(spark):
    items = spark.createDataFrame([("a", 3), ("b", None), ("a", 3), (None, 4)], "name string, length int")
    got = packing.pack(items, 10).collect()
    assert sorted(str(r.name) for r in got) == ["None", "a", "a", "b"] and len({r.sequence_id for r in got if r.length}) == 1
    assert packing.pack(items.limit(0), 10).collect() == []
    with pytest.raises(ValueError):
        packing.pack(items.withColumnRenamed("name", "offset"), 10)


def test_texts_of_megabytes_in_one_batch(spark):
    texts = ["word é " * 300_000, "a", "b c " * 500_000, None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece string").coalesce(1)
    rows = packing.packed_digests(docs, RANKS).collect()
    plain = packing.byte_encoding(RANKS)
    for i, t in enumerate(texts):
        of = sorted((r.start, r.length) for r in rows if r.doc_id == i)
        assert sum(n for _, n in of) == len(plain.encode_ordinary(t or "")) + 1 and [a for a, _ in of] == [sum(n for _, n in of[:k]) for k in range(len(of))]


def test_packing_goes_on_until_one_task_packs_the_rest(spark):
    rng = random.Random(4)
    lengths = [rng.randint(1, 100) for _ in range(4000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "i int, length int").repartition(40)
    rows = packing.pack(items, 100, open_bins=16, rows_a_task=60).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(r.i for r in rows) == list(range(4000))
    for of in bins.values():
        of.sort()
        assert [o for o, _ in of] == [sum(n for _, n in of[:k]) for k in range(len(of))] and sum(n for _, n in of) <= 100
    assert len(bins) <= 1.1 * sum(lengths) / 100
