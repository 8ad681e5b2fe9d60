import pytest
import xxhash

from mirepoix.llm import urlfilter

URLS = [
    None, "", "no scheme", "http://", "http://com/en/", "HTTP://A.COM/en/x?y#z", "https://example.com/en/7", "https://m.example.com/en/77/a", "https://notexample.com/en/7",
    "http://x.net/de/1", "http://example.net/de/8", "http://a.b.example.net/de/81?q", "http://b.org/es/", "http://b.org/ES/", "ftp://b.org#/es/", "http://b.org?/es/", "a://b://c.com/en/", "http://éX.COM/en/", "http://" + "a." * 5000 + "com/en/",
    "http://user@h.com:80/en/", "//x.com/en/", "http://com./en/",
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("most_mapped", [1 << 20, 0])
def test_equals_plain_rules(spark, most_mapped):
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS)] + [(None, URLS[5], "", 1)] * 2, "page_id long, url string, host string, tried int")
    rows = urlfilter.judged(df, most_mapped=most_mapped).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == plain(URLS[5 if r.page_id is None else r.page_id])
    assert urlfilter.judged(df.limit(0), most_mapped=most_mapped).collect() == []


def test_large_list_and_no_rules(spark):
    df = spark.createDataFrame([(i, f"http://s{i}.w{i}.example/p{i}/q") for i in range(300)], "page_id long, url string")
    rules = spark.createDataFrame([(f"w{i}.example", f"/p{i}", "block") for i in range(0, 3000, 2)], "host string, path string, verdict string")
    got = {r.page_id: r.verdict for r in urlfilter.judged(df, rules).collect()}
    assert got == {i: "allow" if i % 2 else "block" for i in range(300)}
    assert {r.verdict for r in urlfilter.judged(df, rules.limit(0)).collect()} == {"allow"}


def test_equal_digests_are_told_apart_by_their_strings(tmp_path, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda data, seed: 7)
    urlfilter.write_list([("a/", "block"), ("b/", "allow")], str(tmp_path / "list"))
    rules = urlfilter.DigestList(str(tmp_path / "list"))
    found = rules.find(np.array([7, 7, 7, 8], dtype=np.uint64), pa.array(["b/", "a/", "c/", "a/"]))
    assert [rules.string(k) if k >= 0 else None for k in found] == [b"b/", b"a/", None, None]


def test_equal_rules_with_different_verdicts_block(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    for rules in ([("com", "/x", "block"), ("com", "/x", "allow")], [("com", "/x", "allow"), ("com", "/x", "block")]):
        for most in (1 << 20, 0):
            assert [r.verdict for r in urlfilter.judged(pages, rules, most_mapped=most).collect()] == ["block"]


def test_null_and_upper_case_rules_are_the_same_mapped_and_joined(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://B.com/y"), (3, None), (4, "http://c.com/z"), (None, "nothing")], "page_id long, url string")
    rules = [("A.COM", "/x", "block"), ("b.com", "/y", None), (None, "/z", "block"), ("c.com", None, "block"), ("c.com", "/z", "odd")]
    want = {1: ("a.com/x", "block"), 2: ("b.com/y", "allow"), 3: (None, "block"), 4: ("c.com/z", "allow"), None: (None, "block")}
    for most in (1 << 20, 0):
        got = urlfilter.judged(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), otherwise="block", most_mapped=most)
        assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == want
    assert urlfilter.judged(pages.limit(0)).collect() == []
