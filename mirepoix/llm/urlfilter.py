"""Allow and block rules for URLs, probed in a memory-mapped sorted array of 64-bit digests."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict); a rule's string is its host and path.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first :// up to / ? # or the end, A-Z lower-cased; then up to ? or #. Both empty for null or no ://."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def write_list(entries: list[tuple[str, str]], path: str) -> None:
    """(string, verdict) entries as one file: count, sorted XXH64 digests, verdicts, string bounds, strings.

    Of equal strings with different verdicts block counts.
    """
    verdicts: dict[str, str] = {}
    for s, v in entries:
        verdicts[s] = max(v, verdicts.get(s, v))
    rows = sorted((xxhash.xxh64_intdigest(s.encode(), seed=42), s.encode(), v) for s, v in verdicts.items())
    ends = np.cumsum([0, *(len(s) for _, s, _ in rows)], dtype="<i8")
    with open(path, "wb") as out:
        out.write(np.array([len(rows)], "<i8").tobytes() + np.array([d for d, _, _ in rows], "<u8").tobytes())
        out.write(ends.tobytes() + np.array([v == "block" for _, _, v in rows], np.uint8).tobytes() + b"".join(s for _, s, _ in rows))


class DigestList:
    """A file of `write_list`, memory-mapped."""

    def __init__(self, path: str):
        n = int(np.memmap(path, "<i8", "r", shape=(1,))[0])
        at = lambda dtype, offset, size: np.memmap(path, dtype, "r", offset, (size,)) if size else np.zeros(0, dtype)
        self.digests, self.ends = at("<u8", 8, n), at("<i8", 8 + 8 * n, n + 1)
        self.blocks = at("u1", 16 + 16 * n, n)
        self.strings = at("u1", 16 + 17 * n, int(self.ends[-1]))

    def find(self, digests: np.ndarray, strings: pa.Array) -> np.ndarray:
        """Each string's entry, -1 for none. A digest that is there counts only if its stored string is the same."""
        found = np.full(len(digests), -1)
        if len(self.digests):
            at = np.searchsorted(self.digests, digests)
            for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == digests):
                want = strings[int(i)].as_py().encode()
                k = at[i]
                while k < len(self.digests) and self.digests[k] == digests[i]:
                    if self.string(k) == want:
                        found[i] = k
                        break
                    k += 1
        return found

    def string(self, k: int) -> bytes:
        return self.strings[self.ends[k] : self.ends[k + 1]].tobytes()


@lru_cache(maxsize=8)
def _opened(name: str) -> DigestList:
    return DigestList(SparkFiles.get(name))


def _candidates(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """The strings that rules for this host and path can have: domains of up to `labels` labels, paths of these lengths."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    domains = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    starts = F.array_compact(F.array(*(F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths)))
    return F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda p: F.concat(d, p))))


def judged(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", otherwise: str = "allow", most_mapped: int = 512 << 20) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    A rule fits its host and all its subdomains if the URL's path starts with its path; the longest rule string wins
    (of equals the larger); of equal rule strings with different verdicts block counts. No rule: `otherwise`. Null, empty and relative URLs have no host, so no rule fits them.
    Repeated rows and null page_ids are kept, other columns ignored; no pages: no rows. rules: (host, path, verdict)
    rows, or a DataFrame of them with columns host, path, verdict; A-Z of their hosts are lower-cased, a null host or
    path makes no rule, and a verdict other than block allows: lists of up to `most_mapped` bytes go to each executor as one
    sorted, memory-mapped file, larger ones are joined.
    """
    spark = pages.sparkSession
    listed = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "host string, path string, verdict string")
    listed = listed.where("host is not null and path is not null").withColumn("host", F.translate("host", _UPPER, _LOWER))
    listed = listed.withColumn("verdict", F.when(F.col("verdict") == "block", "block").otherwise("allow"))
    listed = listed.select(F.concat("host", "path").alias("rule"), "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"))
    size = listed.agg(F.sum(F.octet_length("rule") + 17), F.max("labels"), F.collect_set("length")).first()
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    if size[0] is None:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    rows = rows.withColumn("tried", _candidates(F.col("host"), F.col("path"), size[1], sorted(size[2])))
    found = _mapped(spark, rows, listed, otherwise) if size[0] <= most_mapped else _by_join(rows, listed, otherwise)
    return found.select("page_id", "host", "path", "rule", "verdict")


def _mapped(spark: SparkSession, rows: DataFrame, listed: DataFrame, otherwise: str) -> DataFrame:
    name = f"url-rules-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp()  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    write_list([(r.rule, r.verdict) for r in listed.select("rule", "verdict").toLocalIterator()], os.path.join(folder, name))
    spark.sparkContext.addFile(os.path.join(folder, name))

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _opened(name)
        for batch in stream:
            tried, digests = batch.column(3), batch.column(4)
            strings, ends = tried.flatten(), np.concatenate([[0], np.cumsum(tried.value_lengths().fill_null(0))])
            entry = rules.find(np.array(digests.flatten()).view(np.uint64), strings)
            rule: list = [None] * batch.num_rows
            verdict = [otherwise] * batch.num_rows
            hits = np.flatnonzero(entry >= 0)
            for i, row in zip(hits, np.searchsorted(ends, hits, side="right") - 1):
                text = rules.string(entry[i]).decode()
                if rule[row] is None or (len(text), text) > (len(rule[row]), rule[row]):
                    rule[row], verdict[row] = text, "block" if rules.blocks[entry[i]] else "allow"
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    kind = rows.dtypes[0][1]
    probed = rows.withColumn("digests", F.transform("tried", lambda s: F.xxhash64(s)))
    return probed.mapInArrow(batches, f"page_id {kind}, host string, path string, rule string, verdict string")


def _by_join(rows: DataFrame, listed: DataFrame, otherwise: str) -> DataFrame:
    """The same by a join on the rule strings; each row's candidates are a handful, so its best one is a small maximum."""
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    tries = numbered.select("page_id", "host", "path", "row", F.explode_outer("tried").alias("rule"))
    hits = tries.join(listed.select("rule", "verdict"), "rule", "left")
    best = hits.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


def _oracle() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM rest),
parts AS (SELECT page_id, translate(host, '{_UPPER}', '{_LOWER}') AS host,
                 regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM hosts),
fits AS (SELECT page_id, rule_host || rule_path AS rule, rule_verdict AS verdict,
                row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS nth
         FROM parts JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.nth = 1
"""


ORACLE = _oracle()
