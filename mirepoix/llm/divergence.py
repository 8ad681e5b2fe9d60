"""How the sources of a language differ in their words: shares of terms, summed over pairs of sources and listed by term."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.llm.common import give_back, settled, slices

#: A-Z to a-z, other ASCII that is no letter to a space; bytes of other characters stay.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SCALE = 1_000_000_000


def _words(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, those of some size of it at a time."""
    text = text.translate(_LETTERS)
    at = 0
    while at < len(text):
        to = text.find(b" ", at + size)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def block_counts(docs: DataFrame, entries: int = 1 << 19) -> DataFrame:
    """(lang, source, term, block, df, n): documents with a term and its occurrences, of a block of documents.

    A block ends when it has so many different (lang, source, term), so its memory is bounded; a term's counts of many
    documents leave the task as one row. Each row is a document; null texts, languages and sources are empty.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, counts = TaskContext.get().partitionId() << 32, 0, {}
        for batch in stream:
            for part in slices(batch, 2):
                for lang, source, text in zip(*(c.to_pylist() for c in part.columns)):
                    df, n = counts.setdefault((lang, source), (Counter(), Counter()))
                    held -= len(n)
                    seen: set[bytes] = set()
                    for words in _words(text):
                        n.update(words)
                        seen.update(words)
                    df.update(seen)
                    held += len(n)
                    if held >= entries:
                        yield from _emitted(counts, block)
                        block, held, counts = block + 1, 0, {}
        yield from _emitted(counts, block)
        counts.clear()
        give_back()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("text"))
    return rows.mapInArrow(batches, "lang string, source string, term string, block long, df long, n long")


def _emitted(counts: dict, block: int, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for (lang, source), (df, n) in counts.items():
        terms = list(n)
        for at in range(0, len(terms), rows):
            some = terms[at : at + rows]
            same = lambda x, kind=pa.string(): pa.repeat(pa.scalar(x, kind), len(some))  # noqa: B023, E731
            numbers = [pa.array([c[t] for t in some], pa.int64()) for c in (df, n)]
            yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(some, pa.binary()).cast(pa.string()), same(block, pa.int64()), *numbers], names=["lang", "source", "term", "block", "df", "n"])


def _starts(columns: list[pa.Array], last: tuple | None) -> np.ndarray:
    """Where runs of equal rows start; the first row starts none if it equals `last`."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    for c in columns:
        new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, n - 1)))
    new[0] = tuple(c[0].as_py() for c in columns) != last
    return new


def source_runs(rows: DataFrame) -> DataFrame:
    """(lang, term, source, df, n) summed over blocks: a scan of runs in sorted partitions that holds one run's sums.

    A hash of (lang, term, source) leads the sort: a run needs equal rows side by side, and eight bytes that differ
    are compared far faster than strings that begin alike.
    """

    def scanned(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, (0, 0)
        for batch in stream:
            if not batch.num_rows:
                continue
            keys, numbers = batch.columns[:3], [np.asarray(c) for c in batch.columns[4:]]
            starts = np.flatnonzero(_starts(keys, last))
            cut = np.concatenate([[0], starts]) if not len(starts) or starts[0] else starts
            parts = [np.add.reduceat(x, cut) for x in numbers]
            if cut[0:1].tolist() != starts[:1].tolist():  # the first run goes on from the batch before
                sums = tuple(s + int(p[0]) for s, p in zip(sums, parts))
                parts = [p[1:] for p in parts]
            if len(starts):
                if last is not None:
                    yield _run([[x] for x in last], [[s] for s in sums])
                yield _run([k.take(pa.array(starts[:-1])) for k in keys], [p[:-1] for p in parts])
                last, sums = tuple(k[int(starts[-1])].as_py() for k in keys), tuple(int(p[-1]) for p in parts)
        if last is not None:
            yield _run([[x] for x in last], [[s] for s in sums])

    names = ["lang", "term", "source"]
    dealt = rows.repartition(*names).withColumn("lead", F.xxhash64(*names)).sortWithinPartitions("lead", *names, "block")
    return dealt.select(*names, "block", "df", "n").mapInArrow(scanned, "lang string, term string, source string, df long, n long")


def _run(keys: list, sums: list) -> pa.RecordBatch:
    kinds = [pa.string()] * 3 + [pa.int64()] * 2
    return pa.RecordBatch.from_arrays([pa.array(x, k) if not isinstance(x, pa.Array) else x for x, k in zip([*keys, *sums], kinds)], names=["lang", "term", "source", "df", "n"])


def kept_terms(runs: DataFrame, least_df: int = 30) -> DataFrame:
    """(lang, term, source, n) of the terms in at least so many documents of their language, and one of each with a null source and the sum.

    A second scan, of partitions sorted by language, term and source; it holds a batch and the sources of one term.
    """

    def scanned(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run = None
        for batch in stream:
            rows = pa.concat_batches([open_run, batch]) if open_run else batch
            if rows.num_rows:
                starts = np.flatnonzero(_starts(rows.columns[:2], None))
                yield _kept(rows, starts[:-1], starts[-1], least_df)
                open_run = rows.slice(int(starts[-1]))
        if open_run:
            yield _kept(open_run, np.zeros(1, dtype=np.int64), open_run.num_rows, least_df)

    dealt = runs.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.select("lang", "term", "source", "df", "n").mapInArrow(scanned, "lang string, term string, source string, n long")


def _kept(rows: pa.RecordBatch, starts: np.ndarray, end: int, least_df: int) -> pa.RecordBatch:
    """Of the runs of rows before `end` that are in documents enough, their rows and then a row of each with the sum."""
    lang, term, source, df, n = rows.slice(0, int(end)).columns
    found = np.zeros(0, dtype=bool) if not len(starts) else np.add.reduceat(np.asarray(df), starts) >= least_df
    here = pa.array(np.repeat(found, np.diff(np.append(starts, end))))
    first = pa.array(starts[found])
    sums = np.add.reduceat(np.asarray(n), starts)[found] if len(starts) else np.zeros(0, dtype=np.int64)
    parts = [(lang, lang.take(first)), (term, term.take(first)), (source, pa.nulls(len(first), source.type)), (n, pa.array(sums, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([c.filter(here), own]) for c, own in parts], names=["lang", "term", "source", "n"])


def shares(counts: np.ndarray, total: np.ndarray, smoothing: int = 5) -> np.ndarray:
    """1 + floor(10**9 * (counts + smoothing) / total) without a product beyond 64 bits; total below 9 * 10**15."""
    rest, share = counts + smoothing, np.zeros(np.broadcast(counts, total).shape, dtype=np.int64)
    whole, rest = np.divmod(rest, total)
    share += whole
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        share = share * 1000 + digits
    return share + 1


def divergence(docs: DataFrame, least_df: int = 30, smoothing: int = 5, most: int = 50, rows_a_block: int = 100_000) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and by which terms.

    docs: (text, lang, source) and other columns, which are not used; null values are empty, each row is a document.
    Terms are runs of ASCII letters, lower-cased, and of other non-ASCII characters. Part `pair` has a row for each
    other source of the language, the absolute differences of the shares of all kept terms summed (0 without kept terms);
    part `term` the `most` kept terms that the source has and uses more than the language does. Equal values rank by item.
    No documents: no rows. A language's result has a row for each pair of sources, and a task holds one number for each.

    Counts of blocks are dealt by (lang, term, source) and sorted; a scan of the runs sums them, and a scan of each term's
    sources tells its document frequency. Blocks of terms then give partial sums of pairs and partial lists of terms.
    """
    kept = settled(kept_terms(source_runs(block_counts(docs)), least_df), "kept-terms")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    occurring = docs.select(empty("lang").alias("lang"), empty("source").alias("source")).distinct()
    of_source = kept.where("source is not null").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("n_rows"), F.count_if(F.col("source").isNull()).alias("n_terms"), F.sum(F.when(F.col("source").isNull(), F.col("n"))).alias("lang_total"))
    blocks = F.greatest(F.lit(1), F.ceil(F.coalesce("n_rows", F.lit(0)) / rows_a_block)).cast("int")
    groups = occurring.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "n_terms", "lang_total")), blocks.alias("blocks"))
    groups = settled(groups, "groups")

    def compared(key: tuple, terms: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        heads = heads.sort_values("source", ignore_index=True)
        sources, n_terms, rows = heads["source"].tolist(), int(heads["n_terms"].max()), []
        names = np.unique(terms["term"].to_numpy(dtype=object)) if len(terms) else np.empty(0, dtype=object)
        index = np.searchsorted(names, terms["term"].to_numpy(dtype=object)) if len(terms) else np.empty(0, dtype=np.int64)
        totals = np.append(heads["total"].to_numpy(np.int64), int(heads["lang_total"].max())) + smoothing * n_terms
        column = terms["source"].map({s: i for i, s in enumerate(sources)}).fillna(len(sources)).to_numpy(np.int64)  # the sum's is last
        n, order = terms["n"].to_numpy(np.int64), np.argsort(index, kind="stable")
        sums, best = np.zeros((len(sources), len(sources)), dtype=np.int64), [[] for _ in sources]
        step = max(1, (1 << 20) // len(totals))  # terms at a time
        for at in range(0, len(names), step):
            rows_of = order[np.searchsorted(index[order], at) : np.searchsorted(index[order], at + step)]
            counts = np.zeros((min(step, len(names) - at), len(totals)), dtype=np.int64)
            counts[index[rows_of] - at, column[rows_of]] = n[rows_of]
            p = shares(counts, totals, smoothing)
            for a in range(len(sources)):
                sums[a, a + 1 :] += np.abs(p[:, a + 1 : -1] - p[:, a : a + 1]).sum(axis=0)
                more = np.flatnonzero((counts[:, a] > 0) & (p[:, a] > p[:, -1]))
                best[a] += zip((p[more, a] - p[more, -1]).tolist(), (more + at).tolist())
                best[a] = sorted(best[a], key=lambda x: (-x[0], x[1]))[:most]
        for a, source in enumerate(sources):
            rows += [(key[0], source, "pair", sources[b], int(sums[a, b])) for b in range(a + 1, len(sources))]
            rows += [(key[0], source, "term", names[i], value) for value, i in best[a]]
        return pd.DataFrame(rows, columns=["lang", "source", "part", "item", "value"])

    block = lambda of: F.pmod(F.xxhash64("term"), of).cast("int")
    cut = kept.join(groups.select("lang", "blocks").distinct(), "lang").select("lang", block(F.col("blocks")).alias("block"), "term", "source", "n")
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "n_terms", "lang_total")
    partial = cut.groupBy("lang", "block").cogroup(heads.groupBy("lang", "block")).applyInPandas(compared, "lang string, source string, part string, item string, value long")
    partial = settled(partial, "divergence")
    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    mirrored = F.inline(F.array(F.struct("source", "part", "item", "value"), F.struct(F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")))
    both = pairs.select("lang", mirrored).union(partial.where("part = 'term'"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank).where(f"part = 'pair' or rank <= {most}")


ORACLE = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS terms FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
full_n AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM full_n JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT lang, source, 'pair' AS part, item, coalesce(f, 0)::BIGINT AS value FROM pairs LEFT JOIN f USING (lang, source, item) UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM rows)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
