"""Queries: documents by phrases, prefixes and words of the benchmark's passages, with scores by field and fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirepoix.functions import text as T
from mirepoix.operators import postings
from mirepoix.plans.registry import query
from mirepoix.plans.tables import table

WEIGHTS = {"text": 1.0, "heading": 2.0}
_W = "regexp_extract_all(lower({}), '[a-z0-9]+')"
# what is looked for: words 3 to 6 of a passage as a phrase, with the sixth cut to two letters, and its words 1, 4 and 8 all or any
_FORMS = {"phrase": "array_to_string(w[3:6], ' ')", "phrase_prefix": "array_to_string(w[3:5], ' ') || ' ' || w[6][1:2]", "and": "w[1] || ' ' || w[4] || ' ' || w[8]", "or": "w[1] || ' ' || w[4] || ' ' || w[8]"}
_SEARCH = f"""b AS (SELECT item_id, {_W.format('text')} AS w FROM benchmark), q AS ({" UNION ALL ".join(f"SELECT item_id, '{k}' AS kind, {_W.format(f)} AS w FROM b WHERE len(w) >= 8" for k, f in _FORMS.items())}),
queries AS (SELECT item_id, kind, CASE WHEN kind IN ('and', 'or') THEN list_filter(w, lambda x, i: list_position(w, x) = i) ELSE w END AS w FROM q),
d AS (SELECT doc_id, 'text' AS field, {_W.format('text')} AS w FROM documents UNION ALL SELECT doc_id, 'heading', {_W.format("split_part(text, chr(10), 1)")} FROM documents),
n AS (SELECT field, count(*) AS n, avg(len(w)) AS mean FROM d WHERE len(w) > 0 GROUP BY field),
tf AS (SELECT doc_id, field, term, count(*) AS tf, len FROM (SELECT doc_id, field, unnest(w) AS term, len(w) AS len FROM d) GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
t AS (SELECT item_id, kind, len(w) AS n_words, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS i FROM queries),
terms AS (SELECT item_id, kind, n_words, i, term FROM t WHERE NOT (kind = 'phrase_prefix' AND i = n_words) UNION ALL SELECT item_id, kind, n_words, i, v.term FROM t JOIN (SELECT DISTINCT term FROM df) v ON starts_with(v.term, t.term) WHERE kind = 'phrase_prefix' AND i = n_words),
hits AS (SELECT item_id, kind, n_words, doc_id, tf.field, count(DISTINCT i) AS hit, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) * CASE tf.field WHEN 'heading' THEN 2 ELSE 1 END) AS score
  FROM terms JOIN tf USING (term) JOIN df ON df.field = tf.field AND df.term = terms.term JOIN n ON n.field = tf.field GROUP BY ALL),
joined AS (SELECT doc_id, field, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d),
good AS (SELECT h.*, array_to_string(w, ' ') AS said FROM hits h JOIN queries USING (item_id, kind) JOIN joined USING (doc_id, field) WHERE kind = 'or' OR hit = n_words AND (kind = 'and' OR contains(line, ' ' || array_to_string(w, ' ') || CASE kind WHEN 'phrase' THEN ' ' ELSE '' END))),
best AS (SELECT item_id, kind, doc_id, arg_max(field, (round(score, 9), field)) AS field, max(score) AS score FROM good GROUP BY ALL)"""


def _found(spark, sf_dir, kinds=postings.KINDS):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring_index("text", "\n", 1).alias("heading"))
    w = F.col("w")
    forms = {"phrase": F.array_join(F.slice(w, 3, 4), " "), "phrase_prefix": F.concat_ws(" ", F.array_join(F.slice(w, 3, 3), " "), F.left(F.get(w, F.lit(5)), F.lit(2)))}
    forms |= dict.fromkeys(("and", "or"), F.concat_ws(" ", F.get(w, F.lit(0)), F.get(w, F.lit(3)), F.get(w, F.lit(7))))
    items = table(spark, sf_dir, "benchmark").select("item_id", T.words(F.col("text")).alias("w")).where("size(w) >= 8")
    each = items.select("item_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), f.alias("text")) for k, f in forms.items() if k in kinds))).alias("q"))
    queries = each.select(F.struct("item_id", "q.kind").alias("query_id"), "q.kind", "q.text")
    return docs, postings.search(postings.postings(docs, "doc_id", list(WEIGHTS)), queries, WEIGHTS)


@query("phrase_search", f"WITH {_SEARCH} SELECT item_id, kind, doc_id, field, floor(score * 10000 + 0.3) / 10000 AS score FROM best")
def phrase_search(spark, sf_dir):
    _, found = _found(spark, sf_dir)
    return found.select("query_id.item_id", "query_id.kind", "doc_id", "field", (F.floor(F.col("score") * 10000 + 0.3) / 10000).alias("score"))


@query(
    "phrase_fragments",
    f"""WITH {_SEARCH}, p AS (SELECT item_id, doc_id, b.field, d.w, q.w AS said, list_filter(range(1, len(d.w) + 1), lambda i: d.w[i:i + 3] = q.w)[1] AS first FROM best b JOIN d USING (doc_id, field) JOIN queries q USING (item_id, kind) WHERE kind = 'phrase')
SELECT item_id, doc_id, field, array_to_string(list_concat(list_concat(w[greatest(first - 5, 1):first - 1], list_transform(w[first:first + 3], lambda x: '<em>' || x || '</em>')), w[first + 4:first + 8]), ' ') AS fragment FROM p""",
)
def phrase_fragments(spark, sf_dir):
    docs, found = _found(spark, sf_dir, ["phrase"])
    phrases = found.join(docs, "doc_id")
    words = T.words(F.when(F.col("field") == "text", F.col("text")).otherwise(F.col("heading")))
    return phrases.select("query_id.item_id", "doc_id", "field", postings.fragment(words, F.col("starts"), F.lit(4)).alias("fragment"))
