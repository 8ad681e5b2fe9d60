"""Word-level byte-pair encoding with end-of-word symbols, and its decoding."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirepoix.llm.common import slices

_SPACE = regex.compile(r"\p{White_Space}+").split
_NO_SPACE = re.compile(r"[\x1c-\x1f]").search
#: Capitals newer than Python's own table of letters, with their small letters.
_NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
_NEWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_HAS_NEWER = re.compile("[" + "".join(map(chr, _NEWER)) + "]").search
#: Most words whose encoding a Python worker keeps in each of two generations; a word that is used again moves to the new.
_KEPT = 250_000


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """The tokenizer in a JSON file of the tokenizers library: NFC, one space, lower case; words; BPE with a word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end, self.vocab = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        # by left id and right id: the rank of the merge; by rank: the id that it makes
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(self.strings) + 1)]
        self.makes: list[int] = []
        for rank, merge in enumerate(model["merges"]):
            x, y = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[self.vocab[x]][self.vocab[y]] = rank
            self.makes.append(self.vocab[x + y])
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.end] for s in symbols]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words_of = regex.compile(split.replace(r"\s", r"\p{White_Space}")).findall
        self.parts_of = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda text: [text]
        self.known: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def word(self, word: str) -> list[int]:
        """Ids of one word: a queue of merge ranks over a doubly linked list of symbols; stale entries are skipped."""
        data = word.encode()
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n, ranks, makes = len(ids), self.ranks, self.makes
        bits = n.bit_length()
        mask = (1 << bits) - 1
        # rank_at: the rank of the pair that begins at a place now, -1 if none. A queued entry is rank and place; it is
        # stale if that place has another rank by now.
        rank_at = [ranks[x].get(y, -1) for x, y in zip(ids, ids[1:])]
        rank_at.append(-1)
        queue = [r << bits | i for i, r in enumerate(rank_at) if r >= 0]
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i, rank = entry & mask, entry >> bits
            if rank_at[i] != rank:
                continue
            j = after[i]
            made = ids[i] = makes[rank]
            ids[j] = rank_at[j] = -1
            k = after[i] = after[j]
            right = -1
            if k < n:
                before[k] = i
                right = ranks[made].get(ids[k], -1)
                if right >= 0:
                    heappush(queue, right << bits | i)
            rank_at[i] = right
            h = before[i]
            if h >= 0:
                left = rank_at[h] = ranks[ids[h]].get(made, -1)
                if left >= 0:
                    heappush(queue, left << bits | h)
        return [x for x in ids if x >= 0]

    def chunk(self, chunk: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by spaces, decoded) of a stretch without white space, lower-cased."""
        found = self.older.get(chunk)
        if found is None:
            words = self.words_of(chunk)
            if words == [chunk]:
                ids = self.word(chunk)
                found = (len(ids), " ".join(map(str, ids)), self.decode(ids))
            else:
                found = joined([self.known.get(w) or self.chunk(w) for w in words])
        if len(chunk) <= 64:
            if len(self.known) >= _KEPT:
                self.older, self.known = self.known, {}
            self.known[chunk] = found
        return found

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings, one space between them: the file names no decoder."""
        return " ".join([self.strings[i] for i in ids])

    def text(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, ids joined by spaces, decoded text) of a whole text."""
        found: list[tuple[int, str, str]] = []
        for part in self.parts_of(text or ""):
            if part in self.special:
                i = self.special[part]
                found.append((1, str(i), self.strings[i]))
            elif part:
                known = self.known
                found += [known.get(c) or self.chunk(c) for c in chunks(part)]
        return joined(found)


def joined(found: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    counts, ids, decoded = zip(*found) if found else ((), (), ())
    return sum(counts), " ".join(ids), " ".join(decoded)


def chunks(text: str) -> list[str]:
    """The stretches without white space of a text in normal form C and lower case."""
    text = unicodedata.normalize("NFC", text)
    if not text.isascii() and _HAS_NEWER(text):
        text = text.translate(_NEWER)
    if _NO_SPACE(text):  # split() without a separator would split at these, which are not white space in Unicode
        return [c for c in _SPACE(text.replace("Σ", "σ").lower()) if c]
    # lower() alone would make the sigma at a word's end another letter; the library works letter by letter
    return text.replace("Σ", "σ").lower().split()


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of each whole text: its ids joined by spaces, and what they decode to.

    A null text is empty: no ids. Null and repeated doc_ids keep their rows; other columns are ignored. tokenizer:
    path of the tokenizer's JSON file, there on every executor. Equal words are encoded once in a Python worker. A text
    of over a megabyte is encoded by itself, whole. No docs: no rows.
    """
    return _mapped(docs, tokenizer, doc_id, text, "ids string, decoded string", lambda n, ids, decoded: (ids, decoded))


def digests(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as `encoded`, with SHA-256 digests in the place of the texts."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _mapped(docs, tokenizer, doc_id, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda n, ids, decoded: (n, sha(ids), sha(decoded)))


def _mapped(docs: DataFrame, tokenizer: str, doc_id: str, text: str, columns: str, make) -> DataFrame:
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]
    types = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in columns.split(", ")]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for whole in stream:
            for batch in slices(whole, 1, 512):
                made = zip(*(make(*bpe.text(x)) for x in batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(made, types))], names=names)

    kind = docs.select(doc_id).dtypes[0][1]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(batches, f"doc_id {kind}, {columns}")
