import random
import re

import pytest

from mirepoix.llm import licenses
from mirepoix.llm.license_texts import NOTICES, PHRASES
from mirepoix.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, n_words string, pos int, spans string, x1 long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    words, places, labels = words_of(text), [], set()
    for phrase, label in PHRASES.items():
        of = phrase.split()
        found = [i for i in range(len(words) - len(of) + 1) if words[i : i + len(of)] == of]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def nearest(words, wanted):
    """The least edit distance of the template and any run of words, by the plain recurrence."""
    row = [0] * (len(words) + 1)
    for i, w in enumerate(wanted, 1):
        new = [i]
        for j, x in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def labelled(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "x", 1, "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    rows = {r.doc_id: r for r in licenses.license_labels(df, **options).collect()}
    assert len(rows) == len(texts)
    return [rows[i] for i in range(len(texts))]


def test_base_places_equal_plain_ones(spark):
    rng = random.Random(2)
    parts = ["Under the MIT License", "under the mit", "license", "apache LICENSE, version 2", "version 2.0", "CC BY-NC", "cc by nc", "cc", "by", "Ünder the mit license", "under\tthe\nmit…license", "é"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(1, 12))) for _ in range(300)] + [None, "", "...", "cc by nc cc by nc cc by nc", "CC BY-NC"] + ["under the mit license"] * 40
    for text, row in zip(texts, labelled(spark, texts)):
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == base(text), text
        assert set(row.base_labels.split(",")) - {""} <= set(row.labels.split(","))
        assert row.score == 1.0 if row.n_base else 0 <= row.score <= 1


def test_notices_with_errors_are_found_where_a_plain_distance_finds_them(spark):
    rng, texts = random.Random(4), []
    filler = "lorem ipsum the of and software license this is to in a permission".split()
    for label, text in NOTICES:
        words = words_of(text)
        for share in (0.0, 0.05, 0.15, 0.25, 0.4):
            changed = []
            for w in words:
                kind = rng.random() / share if share else 9
                changed += [] if kind < 0.3 else [w, rng.choice(filler)] if kind < 0.6 else [rng.choice(filler)] if kind < 1 else [w]
            texts.append(" ".join(rng.choices(filler, k=30) + changed + rng.choices(filler, k=30)))
    wanted = [t for t in licenses.templates({}, NOTICES)]
    near = far = 0
    for text, row in zip(texts, labelled(spark, texts, phrases={})):
        words = words_of(text)
        numbers = lambda t: [w for w in t.words if re.search(rb"\d", w)]
        must = {t.label for t in wanted if not numbers(t) and nearest([w.encode() for w in words], t.words) <= t.errors}
        may = {t.label for t in wanted if nearest([w.encode() for w in words], t.words) <= t.errors}
        found = set(row.labels.split(",")) - {""}
        assert must <= found <= may, text
        near, far = near + len(found), far + (not found)
    assert near > 40 and far > 10


def test_spans_and_version_numbers(spark):
    docs = spark.createDataFrame([(1, "one two This work is licensed under the GNU General Public License, version 2. Three")], "doc_id long, text string")
    _, found = licenses.scan(docs)
    rows = {(r.label, r.start, r.stop, r.similarity) for r in found.collect()}
    assert rows == {("gpl-2", 2, 14, 1.0)}


def test_texts_of_several_megabytes_and_a_word_of_one(spark):
    long = "filler words é of it " * 300_000 + "under the mit license" + " x" * 1000 + " cc by nc"
    texts = [long, "y" * 3_000_000 + " under the mit license", "cc by nc " + "z" * 2_500_000 + " a b cc by nc", "é" * 1_500_000]
    for text, row in zip(texts, labelled(spark, texts)):
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == base(text)


def test_repeated_and_null_ids_and_no_documents(spark):
    rows = [(None, "cc by nc"), (None, None), (7, "cc by nc"), (7, "cc by nc"), (7, "under the mit license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_base, r.labels) for r in licenses.license_labels(docs).collect()), key=str)
    assert got == sorted([(None, 1, "cc-by-nc"), (None, 0, ""), (7, 1, "cc-by-nc"), (7, 1, "cc-by-nc"), (7, 1, "mit")], key=str)
    assert licenses.license_labels(docs.limit(0)).collect() == []


def test_a_template_that_cannot_be_found_is_refused():
    with pytest.raises(ValueError):
        licenses.templates({}, [("x", "only five words in it")])


def test_query_over_its_table(spark):
    rows = QUERIES["op13_license_scan"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
