import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mirepoix.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def check(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    n, got, decoded = bpe.word_bpe(PATH).text(text)
    assert (n, got) == (len(ids), " ".join(map(str, ids)))
    assert decoded == LIBRARY.decode(ids, skip_special_tokens=False)


def test_equals_the_library_on_odd_texts():
    for text in ["", "   ", "It's ΣΑΣ ΟΔΟΣ", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", "İx ½ ² Ⅷ x9 １２", "é \x1c \x85 ​ z\xa0q", "日本語 👍🏽", "don't we'LL 'S'", "ab" * 5000]:
        check(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcdeththing' .,!9ΣéẞA\n\x1d<|>") | st.characters(exclude_categories=["Cs", "Cn"]), max_size=40))
def test_equals_the_library(text):
    check(text)


def test_digests_of_null_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "Hello  hello", "z")], "doc_id long, text string, ids string")
    rows = bpe.digests(docs, PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(1, 0), (1, 0), (None, 2)]
    assert rows[0].ids_sha256 == rows[0].decoded_sha256 == rows[1].ids_sha256 == empty
    assert bpe.encoded(docs.where("doc_id is null"), PATH).first().decoded == "hello</w> hello</w>"
    assert bpe.digests(docs.limit(0), PATH).collect() == []


def test_every_code_point_is_lower_cased_as_the_library_does():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).normalizer
    texts = ("x" + chr(c) + "x" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert not [t for t in texts if library.normalize_str(t) != " ".join(bpe.chunks(t))]


def test_texts_of_megabytes_in_one_batch(spark):
    texts = ["word é " * 200_000, "a", "b c " * 300_000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in bpe.encoded(docs, PATH).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == " ".join(map(str, LIBRARY.encode(t or "", add_special_tokens=False).ids))
    assert bpe.digests(docs.limit(0), PATH).collect() == []
