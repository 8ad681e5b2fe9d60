import random
import re
from collections import Counter, defaultdict

import numpy as np

from mirepoix.llm import divergence
from mirepoix.llm.queries import ORACLES, QUERIES
from tests import oracle

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, block string, value string"


def brute(docs, least, most=50):
    out, langs = set(), defaultdict(list)
    for text, lang, source in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        langs[lang or ""].append((source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)))
    for lang, rows in langs.items():
        df = Counter(t for _, terms in rows for t in set(terms))
        kept = [t for t in df if df[t] >= least]
        n = {s: Counter() for s, _ in rows}
        for s, terms in rows:
            n[s].update(t for t in terms if df[t] >= least)
        whole = sum(n.values(), Counter())
        share = lambda of, t: 1 + 10**9 * (of[t] + 5) // (sum(of.values()) + 5 * len(kept))
        for a in n:
            pairs = [(sum(abs(share(n[a], t) - share(n[b], t)) for t in kept), b) for b in n if b != a]
            terms = [(share(n[a], t) - share(whole, t), t) for t in kept if n[a][t] and share(n[a], t) > share(whole, t)]
            for part, found, limit in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out |= {(lang, a, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)}
    return out


def result(spark, docs, **options):
    df = spark.createDataFrame([(1, *d, "x", 3, "b", "v") for d in docs], SCHEMA).repartition(3)
    got = divergence.divergence(df, **options)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    rows = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(n, seed=3):
    rng = random.Random(seed)
    words = ["The", "the", "é", "Élan", "日本", "x9y", "ZZ", "a-b", *(f"w{chr(97 + i)}" for i in range(20))]
    weight = [1 / (i + 1) for i in range(len(words))]
    some = [(" ".join(rng.choices(words, weight, k=rng.randrange(0, 60))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0"] * 4 + ["s1", "s2", None, "é", "z"])) for _ in range(n)]
    return some + [(None, "en", "s9"), ("", "xx", "s0"), ("1 2 3", "xx", "s1"), ("lone word", "yy", None)] + [some[0]] * 5


def test_equals_a_plain_count(spark):
    docs = made(300)
    for least, rows_a_block in ((3, 100_000), (3, 10), (30, 7), (10**6, 10)):
        assert result(spark, docs, least_df=least, rows_a_block=rows_a_block) == brute(docs, least)
    assert result(spark, docs, least_df=2, most=3) == brute(docs, 2, 3)


def test_a_source_with_most_documents_and_one_very_long_text(spark):
    docs = [("common words here", "en", "hot")] * 500 + [("common " + "rare ü " * 400_000, "en", "s1"), ("rare", "en", "s2")] + [("words ü", "en", f"s{i}") for i in range(40)]
    assert result(spark, docs, least_df=2) == brute(docs, 2)


def test_no_documents(spark):
    assert result(spark, []) == set()


def test_blocks_and_runs_across_batches(spark):
    docs = made(200, 8)
    df = spark.createDataFrame([(1, *d, "x", 3, "b", "v") for d in docs], SCHEMA).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        runs = divergence.source_runs(divergence.block_counts(df, entries=20)).collect()
        assert result(spark, docs, least_df=4) == brute(docs, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = defaultdict(lambda: [0, 0])
    for text, lang, source in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        for t, c in Counter(terms).items():
            want[lang or "", t, source or ""][0] += 1
            want[lang or "", t, source or ""][1] += c
    assert len(runs) == len(want)
    assert {(r.lang, r.term, r.source): [r.df, r.n] for r in runs} == want


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(2000):
        total = rng.randrange(1, 9 * 10**15)
        count = rng.randrange(0, total)
        assert divergence.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 5) // total


def test_query_equals_its_sql(spark):
    sf, name = "/root/testdata/sf0.001", "op12_source_divergence_audit"
    assert oracle.differences(spark, oracle.connect(sf), QUERIES[name], ORACLES[name], sf) is None
