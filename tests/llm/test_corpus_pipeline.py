import random

import corpus_pipeline
from mirepoix.llm import quality, simhash, toxicity

from .test_toxicity import rows as toxic_rows


def corpus():
    rng = random.Random(8)
    out = []
    for i, text, toxic in toxic_rows(400):
        words = text.split()
        while len(words) < 70:
            words.append(rng.choice("bcdfgl") + rng.choice(["alba", "coro", "der", "mint"]) + rng.choice("aeiou"))
        out.append((i, " ".join(words), toxic))
    out += [(1000 + k, out[1][1], 0) for k in range(30)] + [(2000, None, 0), (2001, "short", 0), (2002, "a b c " * 40, 0)]
    return out


def test_each_stage_drops_what_its_operator_says(spark, tmp_path):
    data = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t, _ in data], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    wants = [
        lambda d: ids(toxicity.judged(d, labels).where("predicted = 0")),
        lambda d: ids(quality.judged(d).where("kept")),
        lambda d: sorted({r.component_id for r in simhash.similar_documents(d).collect()}),
    ]
    before = docs.count()
    for k, (want, (name, stage)) in enumerate(zip(wants, corpus_pipeline.STAGES)):
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and ids(kept) == want(docs), name
        kept.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() < before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert sorted({r.doc_id for r in packed.collect()}) == ids(docs)
    assert len(set(ids(docs)) & {1, *range(1000, 1030)}) == 1
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in whole.collect()}) == ids(docs)


def test_null_and_repeated_ids_are_kept_by_row(spark):
    rng = random.Random(3)
    text = lambda n=80: " ".join(rng.choice("bcdfgl") + rng.choice(["alba", "coro", "der", "mint"]) + rng.choice("aeiou") for _ in range(n))
    one, two, three = text(), text(), text()
    data = [(None, one), (None, "short"), (None, one), (7, two), (7, two), (7, three), (3, three), (None, two), *((i, text()) for i in range(100, 160))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in data], "doc_id long, text string, lang string")
    passed = [(r.doc_id, r.text) for r in corpus_pipeline.drop_low_quality(spark, docs, "").collect()]
    assert (None, "short") not in passed and passed.count((None, one)) == 2 and passed.count((7, two)) == 2
    left = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted([(None, one), (None, "short"), (7, two), (3, three), *data[8:]], key=str)
