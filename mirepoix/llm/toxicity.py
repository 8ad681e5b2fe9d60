"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirepoix.llm.common import give_back, settled, slices

_HASH, _BASE, _BITS, _RUN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 20, 1 << 18


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in lower case, offsets): text k has those from offsets[k] to offsets[k + 1]; a null text none.

    Letters, digits and marks of every script stay what they are; each white space counts as a blank.
    """
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.concatenate([[0], np.cumsum(np.array(pc.utf8_length(lower), dtype=np.int64))])
    ends = np.frombuffer(lower.buffers()[1], dtype=np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = lower.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if ends[-1] > ends[0] else b""
    points = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
    return np.where((points >= 9) & (points <= 13), np.uint32(32), points), offsets


def ngram_keys(points: np.ndarray, sizes: tuple[int, ...]) -> Iterator[np.ndarray]:
    """For each size the 64-bit hashes of the n-grams of code points that begin at each place, in order."""
    key = np.zeros(len(points), np.uint64)
    for n in range(1, max(sizes) + 1):
        key = key[: max(0, len(points) - n + 1)]
        key = key * _BASE + points[n - 1 :]
        if n in sizes:
            yield key * _HASH + np.uint64(n)


@dataclass
class Model:
    """Weights of n-grams (by their hashes) and an intercept."""

    sizes: tuple[int, ...]  # ascending
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0

    def __post_init__(self):
        # slots for a first look-up; n-grams that share one are searched for in the sorted keys
        order = np.argsort(self.keys)
        self.keys, self.weights = self.keys[order], self.weights[order]
        self.slot = np.zeros(1 << _BITS, dtype=bool)
        self.slot[self._bucket(self.keys)] = True

    @staticmethod
    def _bucket(keys: np.ndarray) -> np.ndarray:
        return ((keys * _HASH) >> np.uint64(64 - _BITS)).astype(np.int64)

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text number, entry number) for each entry that a text holds, once each, in order."""
        points, offsets = code_points(texts)
        pairs, most = [np.zeros(0, np.int64)], max(self.sizes)
        for at in range(0, len(points) if len(self.keys) else 0, _RUN):
            for n, keys in zip(self.sizes, ngram_keys(points[at : at + _RUN + most - 1], self.sizes)):
                keys = keys[:_RUN]
                hits = np.flatnonzero(self.slot[self._bucket(keys)])
                keys = keys[hits]
                entry = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                same = self.keys[entry] == keys
                hits, entry = hits[same] + at, entry[same]
                doc = np.searchsorted(offsets, hits, side="right") - 1
                inside = hits + n <= offsets[doc + 1]
                pairs.append(np.unique(doc[inside] * len(self.keys) + entry[inside]))
        whole = np.unique(np.concatenate(pairs))
        return np.divmod(whole, max(1, len(self.keys)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        doc, entry = self.found(texts)
        z = self.intercept + np.bincount(doc, self.weights[entry], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _ngrams(rows: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """(gram, label, n): number of texts of each label that hold an n-gram, summed by task in part."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in slices(whole, 0, 1000):
                labels = np.array(batch.column(1))
                points, offsets = code_points(batch.column(0))
                for label in (0, 1):
                    held = [np.unique(keys) for k in np.flatnonzero(labels == label) for keys in ngram_keys(points[offsets[k] : offsets[k + 1]], sizes)]
                    if held:
                        grams, counts = np.unique(np.concatenate(held), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), label, np.int32)), pa.array(counts)], names=["gram", "label", "n"])
        give_back()

    return rows.select("text", "label").mapInArrow(batches, "gram long, label int, n long")


def _entropy(*counts: Column) -> Column:
    return sum(((c * F.log(F.greatest(c, F.lit(1e-9)))) for c in counts[1:]), counts[0] * F.log(F.greatest(counts[0], F.lit(1e-9))))


def trained(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows_per_label: int = 12_000, information: float = 0.002, least: float = 12.0, sizes: tuple[int, ...] = (4, 5, 6), alpha: float = 1.0, decay: float = 1.0, steps: int = 300) -> Model:
    """The model of `labels` (doc_id, label 0 or 1) over their docs.

    It is fitted on at most `rows_per_label` labelled rows of each label, those whose doc_id has the smallest hash;
    this bound is the only thing that keeps rows out, and the intercept is set right for it by the counts of all
    labels. Spark counts how many of these texts of each label hold an n-gram; each n-gram's log-count ratio
    r = log((p + alpha) / |p|) - log((q + alpha) / |q|) scales its 0/1 feature. All n-grams that tell `information` nats
    or more of a text's label (the mutual information of both) and more than chance (their log-likelihood ratio G2,
    which is that times twice the texts, is `least` or more; 12 is passed by one in two thousand that tell nothing)
    get weights by logistic regression with L2 decay on those scaled features.
    An id with several rows in docs gives one of them, that with the smallest text. Null labels and doc_ids are left out; of labels that contradict each other the larger counts. If one label is
    missing altogether, the score of all texts is the smoothed share of label 1.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("key")).agg(F.max(label).cast("int").alias("label"))
    counts = dict(known.groupBy("label").count().collect())
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    prior = np.log((n1 + 1) / (n0 + 1))
    if not n0 or not n1:
        return Model(sizes, intercept=float(prior))
    drawn = [known.where(F.col("label") == v).orderBy(F.xxhash64("key"), "key").limit(rows_per_label) for v in (0, 1)]
    chosen = drawn[0].union(drawn[1])  # at most 2 * rows_per_label rows of two numbers
    rows = settled(docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").groupBy("key").agg(F.first("label").alias("label"), F.min("text").alias("text")), "toxicity-rows")
    sizes_of = dict(rows.groupBy("label").count().collect())
    m0, m1 = sizes_of.get(0, 0), sizes_of.get(1, 0)
    if not m0 or not m1:
        return Model(sizes, intercept=float(prior))
    held = _ngrams(rows, sizes).groupBy("gram").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).cast("double").alias("p"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).cast("double").alias("q"))
    p, q, total = F.col("p"), F.col("q"), float(m0 + m1)
    told = _entropy(p, q, m1 - p, m0 - q) - _entropy(p + q, F.lit(total) - p - q) - _entropy(F.lit(float(m1)), F.lit(float(m0))) + _entropy(F.lit(total))
    best = held.withColumn("told", F.round(2 * told, 6)).where(F.col("told") >= max(least, 2 * total * information)).select("gram", "p", "q").toArrow()  # as many as the bounded sample has
    keys = np.array(best.column("gram"), dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    p_, q_ = (np.array(best.column(c), dtype=np.float64)[order] for c in ("p", "q"))
    if not len(keys):
        return Model(sizes, intercept=float(prior))
    ratio = np.log((p_ + alpha) / (p_.sum() + alpha * len(p_))) - np.log((q_ + alpha) / (q_.sum() + alpha * len(q_)))
    blank = Model(sizes, keys[order], np.zeros(len(keys)))
    labels_of, doc, entry = _features(rows, blank)
    w, b = _fitted(labels_of, doc, entry, ratio, decay, steps)
    # labels were drawn in other shares than they have: move the intercept by the log odds between them
    b += np.log(n1 / n0) - np.log(m1 / m0)
    return Model(sizes, blank.keys, w * ratio, float(b))


def _features(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The labels of the (bounded) training rows, and their entries as (row, entry) pairs."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in stream for part in slices(whole, 0)):
            doc, entry = shared.value.found(batch.column(0))
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(entry.astype(np.int32)))], names=["label", "entries"])

    got = rows.select("text", "label").mapInArrow(batches, "label int, entries array<int>").toArrow()
    lists = got.column("entries").combine_chunks()
    return np.array(got.column("label")), np.repeat(np.arange(len(lists)), np.array(pc.list_value_length(lists))), np.array(lists.flatten())


def _fitted(labels, doc, entry, ratio, decay, steps):
    """Logistic regression on ratio-scaled features by accelerated gradient steps, each weight at a rate of its own.

    The rates bound the curvature: a weight's is four over the sum, over the examples that have its feature, of the
    feature's size times the example's, so that the steps converge for long and short texts alike.
    """
    x = ratio[entry]
    n, rows = len(ratio), len(labels)
    size = np.bincount(doc, np.abs(x), minlength=rows) + 1
    rate = 1 / (np.bincount(entry, np.abs(x) * size[doc], minlength=n) / (4 * rows) + decay / n)
    rate_b = 4 * rows / size.sum()
    w = at = np.zeros(n)
    b = b_at = 0.0
    for step in range(steps):
        z = np.bincount(doc, at[entry] * x, minlength=rows) + b_at
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / rows
        new = at - rate * (np.bincount(entry, err[doc] * x, minlength=n) + decay / n * at)
        b_new = b_at - rate_b * err.sum()
        pull = step / (step + 3)
        at, b_at = new + pull * (new - w), b_new + pull * (b_new - b)
        w, b = new, b_new
    return w, b


def scored(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): the score of each whole text, 0 to 1; null and empty texts get the intercept's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], names=["doc_id", "score"])
        give_back()

    kind = docs.select(doc_id).dtypes[0][1]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, f"doc_id {kind}, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the doc_id as text leaves 2 modulo 4; a null doc_id is not one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; learns from rows of labels that aren't held out.

    Null and repeated doc_ids keep their rows; null and empty texts are scored; empty docs: no rows; no labels: all
    get the smoothed share of label 1, one half. Other columns than doc_id and text are ignored.
    """
    model = trained(docs, labels.where(~held_out(F.col("doc_id"))), **settings)
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def sifted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings) -> DataFrame:
    """The rows of docs that `judged` predicts 0 for, with all their columns; nothing is shuffled to drop the others."""
    model = trained(docs, labels.where(~held_out(F.col("doc_id"))), **settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in slices(whole, place):
                yield batch.filter(pa.array(shared.value.scores(batch.column(place)) < threshold))
        give_back()

    return docs.mapInArrow(batches, docs.schema)
