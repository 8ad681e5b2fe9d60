"""Document quality rules: word, symbol and repetition counts, and n-gram perplexity bands by language."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.llm.common import give_back, settled, slices

ORDER, _BITS = 4, 7
_SYMBOLS = 1 << _BITS
_BLOCK = 1 << 20
#: The name under which a whole row is measured.
ROW = "whole__row"


def _symbol_table() -> np.ndarray:
    """The model's symbol of each byte, 1 to 127; 0 stands before a text. Letters keep their case, digits are one."""
    table = np.zeros(256, dtype=np.uint8)
    punctuation = iter(range(57, 91))
    for b in range(256):
        c = chr(b)
        if "a" <= c <= "z":
            table[b] = 1 + b - ord("a")
        elif "A" <= c <= "Z":
            table[b] = 27 + b - ord("A")
        elif "0" <= c <= "9":
            table[b] = 53
        elif c in " \t":
            table[b] = 54
        elif c in "\n\v\f\r":
            table[b] = 55
        elif b < 32 or b == 127:
            table[b] = 56
        elif b < 128:
            table[b] = next(punctuation)
        elif b < 192:
            table[b] = 91 + (b & 31) // 2
        else:
            table[b] = 107 + (b - 192) // 4
    return table


_SYMBOL = _symbol_table()
_MARKS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_IN_WORD = (_SYMBOL <= 53) | (_SYMBOL >= 91)
_SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets of each); null texts have none."""
    whole = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text (see `judged`)."""
    data, offsets = _bytes(texts)
    space = _SPACES[data]
    before = np.concatenate([[True], space[:-1]])[: len(space)]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[starts] = True

    def each(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])

    counts = {"n_words": each(~space & before), "word_chars": each(~space & ((data & 0xC0) != 0x80)), "n_symbols": each(_MARKS[data])}
    lines, repeats = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        if text:
            with_word = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
            lines[k] = len(with_word) - len(set(with_word))
            repeats[k] = repeat_words(text.split())
    return counts | {"n_dup_lines": lines, "n_repeat_words": repeats}


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which occurs twice or more, its first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    places = defaultdict(list)
    for i, window in enumerate(windows):
        places[window].append(i)
    inside = np.zeros(len(words), dtype=bool)
    at = np.array([i for found in places.values() if len(found) > 1 for i in found])
    for step in range(3):
        inside[at + step] = True
    return int(inside.sum())


def _streams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (n-gram ending at each symbol, text number): every symbol of every text once, after ORDER - 1 blanks.

    A run of one mark or space counts as one symbol: the second and later of "!!!" would be no surprise to the model
    and so make up for the first.
    """
    data, offsets = _bytes(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))
    fresh = _IN_WORD[data]
    fresh[1:] |= (data[1:] != data[:-1]) | (doc[1:] != doc[:-1])
    fresh[:1] = True
    data, doc = data[fresh], doc[fresh]
    pad = ORDER - 1
    stream = np.zeros(len(data) + pad * len(texts), dtype=np.uint8)
    place = np.arange(len(data)) + pad * (doc.astype(np.int64) + 1)
    stream[place] = _SYMBOL[data]
    for at in range(0, len(place), _BLOCK):
        p = place[at : at + _BLOCK]
        gram = np.zeros(len(p), dtype=np.uint32)
        for back in range(pad, -1, -1):
            gram = gram << np.uint32(_BITS) | stream[p - back]
        yield gram, doc[at : at + _BLOCK]


def ngram_counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, gram, n): how often each n-gram of symbols occurs in the texts of a language, over all texts."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for whole in stream:
            for batch in slices(whole, 1, 1024):
                langs = np.array(batch.column(0).to_pylist())
                found = defaultdict(list)
                for gram, doc in _streams(batch.column(1)):
                    for name in np.unique(langs):
                        found[name].append(gram[langs[doc] == name])
                for name, parts in found.items():
                    seen[name].append(np.unique(np.concatenate(parts), return_counts=True))
                    if len(seen[name]) >= 16:
                        seen[name] = [_summed(seen[name])]
        for name, parts in seen.items():
            grams, counts = _summed(parts)
            for at in range(0, len(grams), 50_000):
                g, n = grams[at : at + 50_000].astype(np.int64), counts[at : at + 50_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(g)), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])
        give_back()

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(back, np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, n_order, gram, logp, logb): interpolated modified Kneser-Ney (Chen and Goodman, 1998) from n-gram counts.

    logp: log probability of the gram's last symbol after the others, all lower orders mixed in. logb: log of the
    share that the gram leaves to lower orders as the context of a longer one; null if it is none. Lower orders
    count the distinct symbols that a gram follows. Each of the three discounts of an order comes from its counts
    of counts; one that these can't give is its limit, the half of its count.
    """
    below, model = None, None
    by_order = {ORDER: counts.select("lang", "gram", F.col("n").alias("c"))}
    for k in range(ORDER - 1, 0, -1):
        by_order[k] = by_order[k + 1].groupBy("lang", F.col("gram").bitwiseAND((1 << _BITS * k) - 1).alias("gram")).agg(F.count("*").alias("c"))
    contexts = {}
    for k in range(1, ORDER + 1):
        grams = by_order[k]
        of = grams.groupBy("lang").agg(*(F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        cut = [F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.least(F.lit(float(i)), F.greatest(F.lit(0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))))).otherwise(F.lit(i / 2)).alias(f"d{i}") for i in (1, 2, 3)]
        of = F.broadcast(of.select("lang", *cut))
        rows = grams.join(of, "lang").withColumn("h", F.shiftright("gram", _BITS)).withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        within = W.partitionBy("lang", "h")
        rows = rows.withColumn("all", F.sum("c").over(within)).withColumn("left", F.sum("d").over(within) / F.col("all"))
        lower = F.lit(1.0 / _SYMBOLS)
        if below is not None:
            rows = rows.withColumn("short", F.col("gram").bitwiseAND((1 << _BITS * (k - 1)) - 1)).join(below, ["lang", "short"])
            lower = F.col("p_short")
        rows = rows.withColumn("p", (F.col("c") - F.col("d")) / F.col("all") + F.col("left") * lower)
        # the order above and the result read this one several times: unsettled, the plan would double with each order
        rows = settled(rows.select("lang", "gram", "h", "left", "p"), f"order-{k}")
        contexts[k] = rows.groupBy("lang", F.col("h").alias("gram")).agg(F.max("left").alias("left"))
        part = rows.select("lang", F.lit(k).alias("n_order"), "gram", F.log("p").alias("logp"))
        model = part if model is None else model.union(part)
        below = rows.select("lang", F.col("gram").alias("short"), F.col("p").alias("p_short"))
    left = None
    for k in range(1, ORDER + 1):
        part = contexts[k].select("lang", F.lit(k - 1).alias("n_order"), "gram", F.log("left").alias("logb"))
        left = part if left is None else left.union(part)
    return model.join(left, ["lang", "n_order", "gram"], "full")


@dataclass
class Language:
    """One language's model: for each order from 0 its grams, sorted, with their log probabilities and back-off weights."""

    grams: list[np.ndarray]
    logp: list[np.ndarray]
    logb: list[np.ndarray]

    @staticmethod
    def _find(keys: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        return at, keys[at] == grams

    def log_prob(self, grams: np.ndarray) -> np.ndarray:
        out = np.full(len(grams), 0.0)
        todo = np.arange(len(grams))
        for k in range(ORDER, 0, -1):
            if not len(todo):
                return out
            g = grams[todo] & np.uint32((1 << _BITS * k) - 1)
            at, there = self._find(self.grams[k], g)
            there[there] = ~np.isnan(self.logp[k][at[there]])
            out[todo[there]] += self.logp[k][at[there]]
            todo, g = todo[~there], g[~there]
            if len(todo):
                at, known = self._find(self.grams[k - 1], g >> np.uint32(_BITS))
                out[todo[known]] += np.nan_to_num(self.logb[k - 1][at[known]])
        out[todo] -= np.log(_SYMBOLS)
        return out


def sorted_arrays(model: DataFrame) -> dict[str, Language]:
    rows = model.toArrow()
    langs, orders = rows.column("lang").dictionary_encode().combine_chunks(), np.array(rows.column("n_order"))
    grams = np.array(rows.column("gram"))
    logp, logb = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in ("logp", "logb"))
    out = {}
    codes = langs.indices.to_numpy()
    for code, name in enumerate(langs.dictionary.to_pylist()):
        parts = []
        for k in range(ORDER + 1):
            here = np.flatnonzero((codes == code) & (orders == k))
            here = here[np.argsort(grams[here])]
            parts.append((grams[here].astype(np.uint32), logp[here], logb[here]))
        out[name] = Language(*map(list, zip(*parts)))
    return out


def measured(docs: DataFrame, models: dict[str, Language] | None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, base counts, entropy): entropy is the mean -log probability of a text's symbols, null if it has none."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    inside = doc_id == ROW  # the whole row as one struct: its texts travel once

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in slices(whole, whole.column(0).field(text) if inside else whole.column(2)):
                rows = batch.column(0)
                tongue = pc.fill_null(rows.field(lang).cast(pa.string()), "") if inside else batch.column(1)
                texts = rows.field(text) if inside else batch.column(2)
                langs = np.array(tongue.to_pylist())
                total, length = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                for gram, doc in _streams(texts) if shared.value is not None else ():
                    for name in np.unique(langs):
                        here = np.flatnonzero(langs[doc] == name) if (langs != name).any() else slice(None)
                        g, d = gram[here], doc[here]
                        if len(g):
                            first = np.flatnonzero(np.diff(d, prepend=-1))
                            total[d[first]] += np.add.reduceat(-shared.value[str(name)].log_prob(g), first)
                            length[d[first]] += np.diff(np.append(first, len(d)))
                counts = base_counts(texts)
                entropy = pa.array(np.round(total / np.maximum(length, 1), 5), mask=length == 0)
                yield pa.RecordBatch.from_arrays([rows, tongue, *(pa.array(counts[c]) for c in names), entropy], names=["doc_id", "lang", *names, "entropy"])
        give_back()

    kind = docs.select(doc_id).dtypes[0][1]
    rows = docs.select(F.col(doc_id).alias("doc_id"), *([] if inside else [F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text")]))
    return rows.mapInArrow(batches, f"doc_id {kind}, lang string, {', '.join(f'{c} long' for c in names)}, entropy double")


def shorter_half(bins: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(middle, half of the width) of the narrowest run of the sorted bins with over half of their n rows; the lowest of equal ones."""
    upto = np.cumsum(n)
    ends = np.searchsorted(upto, upto - n + upto[-1] // 2 + 1)
    starts = np.flatnonzero(ends < len(bins))
    width = bins[ends[starts]] - bins[starts] + 1
    best = np.argmin(width)
    return bins[starts[best]] + width[best] / 2, width[best] / 2


def bands(entropies: DataFrame, spread: float, least: int = 20) -> DataFrame:
    """(lang, low, high): the middle of a language's entropies, `spread` times half the width of their shorter half to either side.

    The shorter half is the narrowest interval with over half of the rows, read off a histogram with steps of 0.002 of
    all of them: rows elsewhere, up to nearly half of all, neither move its middle far nor widen it much. A language
    of n rows, fewer than `least`, has a middle of its own, but the mean width of the other languages' rows if its own is
    less, times the root of least / n: it is known the less exactly the fewer rows there are.
    """
    step = 0.002

    def halves(group: pa.Table) -> pa.Table:
        group = group.sort_by("bin")
        n = np.array(group.column("n"))
        middle, way = shorter_half(np.array(group.column("bin")), n)
        return pa.table({"lang": group.column("lang")[:1], "n": [int(n.sum())], "middle": [middle * step], "way": [way * step]})

    bins = entropies.where("entropy is not null").groupBy("lang", F.floor(F.col("entropy") / step).alias("bin")).agg(F.count("*").alias("n"))
    own = bins.groupBy("lang").applyInArrow(halves, "lang string, n long, middle double, way double")
    enough = F.col("n") >= least
    usual = own.agg((F.sum(F.when(enough, F.col("way") * F.col("n"))) / F.sum(F.when(enough, F.col("n")))).alias("usual"))
    way = F.when(enough, F.col("way")).otherwise(F.greatest("way", "usual") * F.sqrt(least / F.col("n"))) * spread
    return own.crossJoin(F.broadcast(usual)).select("lang", (F.col("middle") - way).alias("low"), (F.col("middle") + way).alias("high"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def entropies_by_join(docs: DataFrame, model: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, entropy) as `measured` has it, by a join of each text's n-gram counts with a model of any size.

    For models over the size that executors are sent whole. doc_ids must be unique here; n-grams that the model was
    not counted from are taken as equally likely symbols.
    """
    kind = docs.select(doc_id).dtypes[0][1]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for batch in slices(whole, 2, 64):
                for gram, doc in _streams(batch.column(2)):
                    pairs, n = np.unique(doc.astype(np.int64) << 32 | gram, return_counts=True)
                    rows = pa.array(pairs >> 32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pairs & 0xFFFFFFFF), pa.array(n)], names=["doc_id", "lang", "gram", "n"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.col(text).alias("text"))
    grams = rows.mapInArrow(batches, f"doc_id {kind}, lang string, gram long, n long")
    top = model.where((F.col("n_order") == ORDER) & F.col("logp").isNotNull()).select("lang", "gram", F.col("logp").cast("float").cast("double").alias("logp"))
    cost = -F.coalesce("logp", F.lit(-float(np.log(_SYMBOLS)))) * F.col("n")
    return grams.join(top, ["lang", "gram"], "left").groupBy("doc_id").agg(F.round(F.sum(cost) / F.sum("n"), 5).alias("entropy"))


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", spread: float = 6.0, most_entries: int = 4_000_000) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, entropy, low, high, kept) for each row.

    Words lie between ASCII white space. word_chars: code points in words; n_symbols: characters of #*$%&|<>;
    n_dup_lines: lines with a word that equal an earlier line; n_repeat_words: words in three-word windows found twice
    or more. base_failed: under 50 words, or over half of them repeated. Others are kept if the entropy (log of the
    perplexity) of their characters, in the model of all documents of their language, is within the language's bands,
    which are taken from the documents that don't fail (see `bands`). A null lang counts as the empty string; a language
    without such documents has no bands, and none to keep. A null text has no words, so it fails. Null and repeated
    doc_ids keep their rows, other columns are ignored, no rows give no rows.

    The model of all languages goes to executors as sorted arrays, at most `most_entries` of them (16 bytes each); a
    larger one is joined with the documents' n-grams.
    """
    rows, failed, inside = _measured_and_limits(docs, doc_id, text, lang, spread, most_entries)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "entropy", "low", "high", (~failed & inside).alias("kept")
    )


def sifted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", spread: float = 6.0, most_entries: int = 4_000_000) -> DataFrame:
    """The rows of docs that `judged` keeps, with all their columns; they travel with their counts and are not shuffled."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(ROW), F.col(text).alias(text), F.col(lang).alias(lang))
    rows, failed, inside = _measured_and_limits(whole, ROW, text, lang, spread, most_entries)
    return rows.where(~failed & inside).select("doc_id.*")


def _measured_and_limits(docs: DataFrame, doc_id: str, text: str, lang: str, spread: float, most_entries: int) -> tuple[DataFrame, Column, Column]:
    """(`measured` rows with their language's low and high, whether they fail the base rules, whether they are inside)."""
    counts = settled(ngram_counts(docs, lang, text), "ngrams")
    model = settled(kneser_ney(counts), "kneser-ney")
    if model.count() <= most_entries:
        rows = settled(measured(docs, sorted_arrays(model), doc_id, text, lang), "measured")
    else:
        own = settled(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).withColumn("row", F.monotonically_increasing_id()), "rows")
        joined = entropies_by_join(own, model, "row").withColumnRenamed("doc_id", "row")
        base = measured(own.withColumn("doc_id", F.struct("row", "doc_id")), None)
        rows = base.drop("entropy").withColumns({"row": F.col("doc_id.row"), "doc_id": F.col("doc_id.doc_id")}).join(joined, "row", "left").drop("row")
        rows = settled(rows, "measured")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    limits = F.broadcast(bands(rows.where(~failed), spread))  # a row for each language
    inside = F.coalesce(F.col("entropy").between(F.col("low"), F.col("high")), F.lit(True))
    return rows.join(limits, "lang", "left"), failed, inside
