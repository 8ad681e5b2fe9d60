"""License scans: word k-grams of texts joined to their places in templates, counted by offset diagonal and verified."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.llm.common import give_back, settled, slices
from mirepoix.llm.license_texts import NOTICES, PHRASES

#: A-Z to a-z, other ASCII that is neither letter nor digit to a space; bytes of other characters stay.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_CHUNK, _BASE = 1 << 20, 0x9E3779B97F4A7C15
GRAM = 3


@dataclass(frozen=True)
class Template:
    """Words to find: `errors` of them may be changed, left out or put in; a phrase is found word for word."""

    label: str
    words: tuple[bytes, ...]
    phrase: bool

    @property
    def errors(self) -> int:
        return 0 if self.phrase else len(self.words) // 5

    @property
    def votes(self) -> int:
        """k-grams that any place within the errors shares with the template at least: an error breaks k of them."""
        return len(self.words) - GRAM + 1 - GRAM * self.errors


def templates(phrases: Mapping[str, str], notices: Sequence[tuple[str, str]]) -> list[Template]:
    """Templates of phrases and notices; one with so few words that a place may share no k-gram with it is refused."""
    made = [Template(label, tuple(text.encode().translate(_WORD).split()), True) for text, label in phrases.items()]
    made += [Template(label, tuple(text.encode().translate(_WORD).split()), False) for label, text in notices]
    for t in made:
        if t.votes < 1:
            raise ValueError(f"a template has too few words: {t}")
    return made


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, for places in a chunk and a long word's end."""
    at = np.full(2 * _CHUNK, _BASE, dtype=np.uint64)
    back = np.full(2 * _CHUNK, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    at[0] = back[0] = 1
    return np.cumprod(at, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_places(text: bytes, hashes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, hashes) of the words of a text whose other bytes are spaces; read in chunks of about a MB."""
    at, found = 0, []
    while at < len(text):
        to = text.find(b" ", at + _CHUNK)
        to = len(text) if to < 0 else to
        a = np.frombuffer(text, np.uint8, to - at, at)
        inside = np.zeros(len(a) + 2, dtype=np.int8)
        inside[1:-1] = a != 32
        edges = np.flatnonzero(np.diff(inside))
        starts, stops = edges[::2], edges[1::2]
        h = np.zeros(0, np.uint64)
        if hashes and len(a) <= 2 * _CHUNK:
            power, inverse = _powers()
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(a * power[: len(a)], dtype=np.uint64)])
            h = _mixed((upto[stops] - upto[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
        elif hashes:  # its last word is longer than a chunk: no template has it, so its length will do
            h = np.append(word_places(text[at : at + starts[-1]])[2], np.uint64(stops[-1] - starts[-1]))
        found.append((starts + at, stops + at, h))
        at = to
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def _gram_hashes(h: np.ndarray) -> np.ndarray:
    """One hash for each run of GRAM words, by the same polynomial; empty if there are fewer."""
    n = max(len(h) - GRAM + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for j in range(GRAM):
        rolled = rolled * np.uint64(_BASE) + h[j : j + n]
    return _mixed(rolled).view(np.int64)


def _text_key() -> list[Column]:
    """A text's identity: two 64-bit hashes."""
    return [F.xxhash64(F.lit(seed), "text").alias(name) for seed, name in ((1, "x1"), (2, "x2"))]


def gram_rows(docs: DataFrame, grams_a_row: int = 1 << 14) -> DataFrame:
    """(doc_id, x1, x2, n_words, base, grams): the k-gram hashes of each document from word `base`, some thousands a row.

    A document's first row alone has its n_words. docs: (doc_id, text), the texts not null.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                joined = b" ".join(texts).translate(_WORD)
                ends = np.cumsum([len(t) + 1 for t in texts])
                starts, _, h = word_places(joined)
                upto = np.searchsorted(starts, ends).tolist()
                rows, values, first = [], [], 0
                for i, last in enumerate(upto):
                    of = _gram_hashes(h[first:last])
                    for base in range(0, max(1, len(of)), grams_a_row):
                        rows.append((i, last - first if not base else None, base))
                        values.append(of[base : base + grams_a_row])
                    first = last
                index, n_words, base = zip(*rows)
                grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]), pa.int32()), pa.array(np.concatenate(values)))
                same = [part.column(c).take(pa.array(index)) for c in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(n_words, pa.int64()), pa.array(base, pa.int64()), grams], names=["doc_id", "x1", "x2", "n_words", "base", "grams"])
        give_back()

    kind = docs.select("doc_id").dtypes[0][1]
    rows = docs.select("doc_id", F.col("text").cast("binary"), *_text_key())
    return rows.mapInArrow(batches, f"doc_id {kind}, x1 long, x2 long, n_words long, base long, grams array<long>")


def template_places(spark: SparkSession, wanted: Sequence[Template]) -> DataFrame:
    """(gram, places): a row for each different k-gram hash of the templates, with (template number, word) where it begins."""
    rows = [(int(g), i, at) for i, t in enumerate(wanted) for at, g in enumerate(_gram_hashes(word_places(b" ".join(t.words))[2]))]
    places = spark.createDataFrame(rows, "gram long, template int, at long")
    grouped = places.groupBy("gram").agg(F.collect_list(F.struct("template", "at")).alias("places"))
    return F.broadcast(grouped) if len(rows) <= 1 << 20 else grouped


def candidate_spans(hits: DataFrame, wanted: Sequence[Template]) -> DataFrame:
    """(x1, x2, spans) of (x1, x2, pos, place): stretches (template, start, stop) that may hold the template within its errors.

    Votes are counted by (text, template, diagonal), the diagonal being the k-gram's place in the text less that in the
    template. Diagonals that lie within the template's errors of each other are merged, as words put in or left out
    move what follows to a neighbour, and those with votes enough for some place are kept: none that verifies is lost.
    """
    rules = hits.sparkSession.createDataFrame([(i, len(t.words), t.errors, t.votes) for i, t in enumerate(wanted)], "template int, length long, errors long, least long")
    one = hits.select("x1", "x2", "place.template", "place.at", (F.col("pos") - F.col("place.at")).alias("diagonal")).distinct()
    lines = one.groupBy("x1", "x2", "template", "diagonal").agg(F.count("*").alias("votes")).join(F.broadcast(rules), "template")
    along = W.partitionBy("x1", "x2", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.col("errors"), F.lit(True))
    merged = lines.withColumn("apart", apart.cast("int")).withColumn("band", F.sum("apart").over(along))
    bands = merged.groupBy("x1", "x2", "template", "band", "length", "errors", "least").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    start, stop = F.greatest(F.col("low") - F.col("errors"), F.lit(0)), F.col("high") + F.col("length") + F.col("errors")
    return bands.where("votes >= least").groupBy("x1", "x2").agg(F.collect_list(F.struct("template", start.alias("start"), stop.alias("stop"))).alias("spans"))


def _distances(words: np.ndarray, template: np.ndarray, free_start: bool = True) -> np.ndarray:
    """The least edit distance between the template and a run of words that ends at each place, 0 to len(words)."""
    step = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, dtype=np.int64) if free_start else step
    for word in template:
        new = row + 1
        np.minimum(new[1:], row[:-1] + (words != word), out=new[1:])
        row = np.minimum.accumulate(new - step) + step
    return row


def verified(words: list[bytes], template: Template) -> Iterator[tuple[int, int, float]]:
    """(start, stop, similarity) of the places in words that hold the template within its errors, the nearest of those that overlap.

    The words of a template with digits, version numbers, must all be there.
    """
    size = len(template.words)
    if template.phrase:
        for at in range(len(words) - size + 1):
            if tuple(words[at : at + size]) == template.words:
                yield at, at + size, 1.0
        return
    number = {w: i for i, w in enumerate(template.words)}
    of, text = (np.array([number.get(w, -1) for w in x], dtype=np.int64) for x in (template.words, words))
    distance = _distances(text, of)
    places = []
    for stop in np.flatnonzero(distance <= template.errors).tolist():
        if places and stop - places[-1][0] < size / 2:
            places[-1] = min(places[-1], (stop, int(distance[stop])), key=lambda p: p[1])
        else:
            places.append((stop, int(distance[stop])))
    for stop, errors in places:
        back = _distances(text[max(0, stop - size - template.errors) : stop][::-1], of[::-1], free_start=False)
        start = stop - int(np.argmin(back))
        if all(w in words[start:stop] for w in template.words if any(48 <= b <= 57 for b in w)):
            yield start, stop, 1 - errors / size


def verified_spans(docs: DataFrame, spans: DataFrame, wanted: Sequence[Template]) -> DataFrame:
    """(x1, x2, template, start, stop, similarity) of the spans that hold their template, of each text one."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in slices(batch, 2):
                rows = []
                for x1, x2, text, stretches in zip(*(c.to_pylist() for c in part.columns)):
                    text = text.translate(_WORD)
                    starts, stops, _ = word_places(text, hashes=False)
                    found = set()
                    for s in stretches:
                        words = [text[a:b] for a, b in zip(starts[s["start"] : s["stop"]].tolist(), stops[s["start"] : s["stop"]].tolist())]
                        found |= {(s["template"], s["start"] + a, s["start"] + b, x) for a, b, x in verified(words, wanted[s["template"]])}
                    rows.append((x1, x2, [dict(zip(("template", "start", "stop", "similarity"), f)) for f in sorted(found)]))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("template", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("similarity", pa.float64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["x1", "x2", "found"])
        give_back()

    texts = docs.select(F.col("text").cast("binary").alias("text"), *_text_key()).join(spans, ["x1", "x2"]).select("x1", "x2", "text", "spans")
    found = texts.mapInArrow(batches, "x1 long, x2 long, found array<struct<template: int, start: long, stop: long, similarity: double>>")
    return found.groupBy("x1", "x2").agg(F.any_value("found").alias("found")).select("x1", "x2", F.inline("found"))


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): (doc_id, x1, x2, n_words) of each document, and (x1, x2, template, start, stop, similarity, label, phrase) of each different text.

    Texts are whole; a null text is empty. Words are runs of ASCII letters, lower-cased, digits and other non-ASCII
    characters. Templates in phrases, text -> label, are found word for word, all places; those in notices, (label,
    text), with up to a fifth of the words changed, left out or put in; of places that overlap the nearest counts.
    A text is known by two 64-bit hashes, so equal texts are verified alike; null and repeated doc_ids keep their rows.
    """
    wanted, spark = templates(phrases, notices), docs.sparkSession
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    grams = gram_rows(texts).select("doc_id", "x1", "x2", "n_words", "base", F.posexplode_outer("grams").alias("i", "gram"))
    joined = grams.join(template_places(spark, wanted), "gram", "left")
    first = (F.col("base") == 0) & (F.coalesce("i", F.lit(0)) == 0)
    rows = joined.where(first | F.col("places").isNotNull())
    rows = settled(rows.select("doc_id", "x1", "x2", F.when(first, F.col("n_words")).alias("n_words"), (F.col("base") + F.col("i")).alias("pos"), "places"), "license-hits")
    hits = rows.where("places is not null").select("x1", "x2", "pos", F.explode("places").alias("place"))
    spans = settled(candidate_spans(hits, wanted), "license-spans")
    labels = spark.createDataFrame([(i, t.label, t.phrase) for i, t in enumerate(wanted)], "template int, label string, phrase boolean")
    found = settled(verified_spans(texts, spans, wanted).join(F.broadcast(labels), "template"), "license-found")
    return rows.where("n_words is not null").select("doc_id", "x1", "x2", "n_words"), found


def license_labels(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each document (see scan).

    n_base: places of phrases, first_word and last_word their least and largest first word, null without any;
    base_labels and labels: of phrases and of all, distinct, sorted and comma-joined. score: the largest similarity of
    a place to its template, 0 without any. No documents: no rows.
    """
    rows, found = scan(docs, phrases, notices)
    at = F.when(F.col("phrase"), F.col("start"))
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    of_text = found.groupBy("x1", "x2").agg(
        F.count(at).alias("n_base"), F.min(at).alias("first_word"), F.max(at).alias("last_word"), listed(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), listed("label").alias("labels"), F.max("similarity").alias("score")
    )
    whole = rows.join(of_text, ["x1", "x2"], "left")
    default = {"n_base": F.lit(0), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return whole.select("doc_id", "n_words", *((F.coalesce(c, default[c]).alias(c) if c in default else F.col(c)) for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score")))
