import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from mirepoix.llm import quality

WHITE = " \t\n\v\f\r"


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in WHITE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def plain_base(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def symbols(text):
    data = (text or "").encode()
    keep = [b for i, b in enumerate(data) if quality._IN_WORD[b] or i == 0 or data[i - 1] != b]
    return [0, 0, 0, *(int(quality._SYMBOL[b]) for b in keep)]


class PlainModel:
    def __init__(self, texts):
        tables = {4: Counter()}
        for t in texts:
            s = symbols(t)
            tables[4].update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
        for k in (3, 2, 1):
            tables[k] = Counter(g[1:] for g in tables[k + 1])
        self.tables, self.cuts, self.totals, self.left = tables, {}, {}, {}
        for k, table in tables.items():
            n = Counter(table.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
            self.cuts[k] = [min(i, max(0.05, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] and n[1] else i / 2 for i in (1, 2, 3)]
            self.totals[k], self.left[k] = defaultdict(float), defaultdict(float)
            for g, c in table.items():
                self.totals[k][g[:-1]] += c
                self.left[k][g[:-1]] += self.cuts[k][min(c, 3) - 1]

    def p(self, g):
        if not g:
            return 1 / 128
        k, h = len(g), g[:-1]
        if not self.totals[k].get(h):
            return self.p(g[1:])
        c = self.tables[k].get(g, 0)
        own = (c - self.cuts[k][min(c, 3) - 1]) / self.totals[k][h] if c else 0
        return own + self.left[k][h] / self.totals[k][h] * self.p(g[1:])

    def entropy(self, text):
        s = symbols(text)
        return -sum(math.log(self.p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / (len(s) - 3)


def corpus(n=90):
    rng = random.Random(2)
    rows = [(0, None, "en"), (1, "", "en"), (2, "  \n ", None), (3, "a b c a b c\nx\n\nx\n x", "en"), (4, "é## é <x> |\n" * 40, "fr")]
    for i in range(5, n):
        text = " ".join(rng.choice("abdlmr") + rng.choice(["the", "And", "é12", "rain,", "sea.\n"]) + rng.choice("aeiou") for _ in range(rng.randint(40, 90)))
        rows.append((i, text if i % 30 else "".join(rng.choice("#!?Qxz ") for _ in range(600)), ["en", "de"][i % 2]))
    return rows


@pytest.mark.parametrize("most_entries", [10**6, 0])
def test_counts_and_entropies_equal_plain_ones(spark, most_entries):
    rows = corpus()
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, kept boolean").repartition(5)
    got = {r.doc_id: r for r in quality.judged(docs, most_entries=most_entries).collect()}
    assert set(got) == {r[0] for r in rows}
    models = {lang: PlainModel([t for _, t, l in rows if (l or "") == (lang or "")]) for lang in {r[2] for r in rows}}
    for i, text, lang in rows:
        r = got[i]
        assert tuple(r[1:6]) == plain_base(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if text:
            assert r.entropy == pytest.approx(models[lang].entropy(text), abs=2e-4)
        else:
            assert r.entropy is None
        within = r.low is None or r.entropy is None or r.low <= r.entropy <= r.high
        assert r.kept == (not r.base_failed and within)
    assert not any(got[i].kept for i in got if i >= 5 and i % 30 == 0)
    assert sum(r.kept for r in got.values()) > 20


def test_unseen_grams_back_off(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = quality.kneser_ney(quality.ngram_counts(docs.where("lang = 'en'"), "lang", "text"))
    arrays = quality.sorted_arrays(model)
    plain = PlainModel([t for _, t, l in rows if l == "en"])
    rng = np.random.default_rng(1)
    grams = [tuple(map(int, rng.integers(1, 122, 4))) for _ in range(300)] + [(20, 8, 5, int(x)) for x in range(1, 122)]
    got = arrays["en"].log_prob(np.array([a << 21 | b << 14 | c << 7 | d for a, b, c, d in grams], dtype=np.uint32))
    assert np.allclose(got, [math.log(plain.p(g)) for g in grams], atol=1e-4)


def test_empty_table(spark):
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def banded(spark, rows):
    found = quality.bands(spark.createDataFrame(rows, "lang string, entropy double"), 6.0).collect()
    return {r.lang: (r.low, r.high) for r in found}


def test_a_third_of_junk_stays_outside_the_bands(spark):
    rng = np.random.default_rng(4)
    clean = rng.normal(1.5, 0.02, 2000)
    rows = [(lang, float(e)) for lang, at in (("high", 1.9), ("low", 1.1)) for e in (*clean, *rng.normal(at, 0.05, 1000))]
    for lang, (low, high) in banded(spark, rows).items():
        e = np.array([x for name, x in rows if name == lang])
        inside = (e >= low) & (e <= high)
        assert inside[:2000].mean() > 0.99 and inside[2000:].mean() < 0.01, lang


def test_few_documents_have_bands_as_wide_as_usual(spark):
    rng = np.random.default_rng(5)
    rows = [("en", float(e)) for e in rng.normal(1.5, 0.02, 500)] + [("rare", e) for e in (1.0, 1.01, 1.02, 1.03, 1.06, 1.9)] + [("one", 0.7)]
    got = banded(spark, rows)
    assert got["rare"][0] < 1.0 and 1.06 < got["rare"][1] < 1.9 and got["one"][0] < 0.7 < got["one"][1]
    assert banded(spark, rows[-1:])["one"][0] < 0.7 < banded(spark, rows[-1:])["one"][1]


def test_documents_that_fail_base_rules_do_not_move_the_bands(spark):
    junk = [(1000 + k, " ".join(f"{c}{k}" for c in "#!?Qxz|~"), "de") for k in range(90)]
    found = quality.judged(spark.createDataFrame(corpus() + junk, "doc_id long, text string, lang string")).collect()
    german = [r for r in found if r.doc_id >= 5 and r.low is not None and (r.doc_id % 2 or r.doc_id >= 1000)]
    assert all(r.base_failed for r in german if r.doc_id >= 1000)
    low, high = banded(spark, [("de", r.entropy) for r in german if not r.base_failed])["de"]
    assert all((r.low, r.high) == pytest.approx((low, high)) for r in german)
