import math
import random
from collections import Counter

import pytest

from mirepoix.llm import lmscore


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


class PlainModels:
    """Both models with dictionaries, by the formulas of lmscore.scored."""

    def __init__(self, target, background, weight=5.0):
        self.weight = weight
        self.one, self.two, self.context = zip(*(self.counted(texts) for texts in (background, target)))
        self.v = len(set(self.one[0]) | set(self.one[1]))

    @staticmethod
    def counted(texts):
        one, two, context = Counter(), Counter(), Counter()
        for text in texts:
            w = words(text)
            one.update(w)
            two.update(zip([None, *w], w))
            context.update([*w, None] if w else [])
        return one, two, context

    def losses(self, text):
        sums = [0.0, 0.0]
        w = words(text)
        for h, x in zip([None, *w], w):
            low = (self.one[0][x] + 1) / (self.one[0].total() + self.v + 1)
            single = [low, (self.one[1][x] + self.weight * low) / (self.one[1].total() + self.weight)]
            for k in (0, 1):
                sums[k] -= math.log((self.two[k][h, x] + self.weight * single[k]) / (self.context[k][h] + self.weight))
        return [s / max(1, len(w)) for s in sums]


def check(got, text, plain):
    background, target = plain.losses(text)
    assert got.n_tokens == len(words(text))
    if words(text):
        assert got.target_loss == pytest.approx(target, abs=2e-6) and got.background_loss == pytest.approx(background, abs=2e-6)
        assert got.score == pytest.approx(target - background, abs=2e-6)
    else:
        assert got.score is got.target_loss is got.background_loss is None


def corpus():
    rng = random.Random(6)
    make = lambda good: " ".join(rng.choice(["oak", "Elm", "ÄSH"] if good else ["ZX9", "##", "qq"]) + rng.choice("aeiou") for _ in range(rng.randint(1, 40)))
    return [(i, make(i % 3 == 0)) for i in range(90)] + [(90, None), (91, ""), (92, " \t\n"), (93, "\nz" * 3)]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 300, "part_words": 20}])
def test_losses_equal_plain_models_and_rank_the_target(spark, sizes):
    rows = corpus()
    labels = [(i, int(i % 3 == 0), 0) for i in range(0, 90, 2)] + [(None, 1, 0), (5000, 1, 1), (4, None, 0)]
    docs = spark.createDataFrame([(*r, 0.0, r[0], 1) for r in rows], "doc_id long, text string, score double, good__id long, block int").repartition(4)
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **sizes).collect()}
    good = {i for i, q, _ in labels if q}
    plain = PlainModels([t for i, t in rows if i in good], [t for _, t in rows])
    for i, text in rows:
        check(got[i], text, plain)
    assert max(got[i].score for i in range(0, 90, 3)) < min(got[i].score for i in range(1, 90, 3))


def test_texts_of_no_model_are_scored(spark):
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs, target, background = ["new words", "oak elm new", "qq qq", None], ["oak elm oak", "elm"], ["qq oak qq", "", None]
    got = {r.doc_id: r for r in lmscore.scored(frame(docs), frame(target), frame(background)).collect()}
    assert len(got) == len(docs)
    plain = PlainModels(target, background)
    for i, text in enumerate(docs):
        check(got[i], text, plain)


def test_a_text_that_occurs_twice_is_better_known(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice(["ka", "lo", "mi", "ne", "tu", "re"]) for _ in range(3)) for _ in range(200))
    twice = [text() for _ in range(20)]
    data = [*twice, *twice, *(text() for _ in range(200))]
    docs = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lmscore.cross_entropy_difference(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert min(got[i] for i in range(40)) > max(got[i] for i in range(40, 240))


def test_no_target_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "abc"), (1, "abc"), (None, "abc x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = lmscore.cross_entropy_difference(docs, labels).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 2] and len({r.score for r in rows if r.doc_id}) == 1
    assert lmscore.cross_entropy_difference(docs.limit(0), labels).collect() == []


def test_long_texts_are_cut_and_put_together(spark, monkeypatch):
    text = " ".join(f"w{i % 97}" + "x" * (i % 5) for i in range(4000))
    whole = list(lmscore._segments(text.encode()))
    assert len(whole) == 1
    monkeypatch.setattr(lmscore, "_SEGMENT", 1000)
    cut = list(lmscore._segments(text.encode()))
    assert len(cut) > 10 and b"".join(s for s, _ in cut) == text.encode()
    for (a, _), (_, before) in zip(cut, cut[1:]):
        assert before == lmscore.word_hashes(a)[0][-1]
    assert list(lmscore._segments(b"")) == [(b"", lmscore._START)]
    assert len(list(lmscore._segments(b"y" * 5000))) == 1
    monkeypatch.undo()
    long = " ".join(f"w{i % 977}" for i in range(1_000_000))  # 5 MB: two segments
    docs = spark.createDataFrame([(1, long), (2, "w1 w2 w3")], "doc_id long, text string")
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(docs, spark.createDataFrame([(2, 1)], "doc_id long, quality int")).collect()}
    plain = PlainModels(["w1 w2 w3"], [long, "w1 w2 w3"])
    for i, t in ((1, long), (2, "w1 w2 w3")):
        check(got[i], t, plain)
