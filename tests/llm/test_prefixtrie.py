import hashlib
import random
import zlib
from collections import defaultdict

from mirepoix.llm import prefixtrie
from mirepoix.llm.queries import ORACLES, QUERIES
from tests import oracle

SCHEMA = "conv_id long, turn long, role string, text string, depth int, x1 string, last boolean"


def brute(rows):
    """The contract, step by step over whole prefixes."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            key = hashlib.md5(f"{len(role or '')}:{role or ''}:{text or ''}".encode()).digest()
            own[conv_id].append((turn is not None, turn or 0, role or "", key, text or ""))
    own = {c: [(role, text) for *_, role, _, text in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h, donor = zlib.crc32(str(c).encode()) % 9, c - int(abs(c) % 5 * (1 if c >= 0 else -1))
        rebuilt[c] = own.get(donor, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, path in sorted(rebuilt.items()):
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    ends = {p: ",".join(str(c) for c in m if len(rebuilt[c]) == len(p)) for p, m in members.items()}
    return {
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest())
        for p, m in members.items()
    }


def nodes(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], SCHEMA).repartition(4)
    out = prefixtrie.shared_head_trie(df)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_trie_equals_a_plain_one(spark):
    rng, rows = random.Random(5), []
    for c in [*range(-12, 60), 10**15 + 3, 10**15 + 4]:
        if rng.random() < 0.85:
            for turn in range(rng.randrange(1, 14)):
                rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", None, ""]), rng.choice(["é", "aa", "", None])))
    rows += [(3, 2, "user", "aa")] * 3 + [(None, 0, "user", "x"), (None, None, None, None)]
    assert nodes(spark, rows) == brute(rows)


def test_a_conversation_with_a_third_of_all_turns_and_copies(spark):
    rows = [(40, i, "user", f"t{i % 7}") for i in range(900)] + [(c, i, "user", f"t{i}") for c in range(100, 300) for i in range(9)]
    assert nodes(spark, rows) == brute(rows)


def test_turnless_conversations_and_no_conversations(spark):
    few = [(c, 0, "user", "hello") for c in (1, 2, 3, 4, 6, 7)]  # some have fewer turns than their heads take
    assert nodes(spark, few) == brute(few)
    assert nodes(spark, []) == set()
    assert nodes(spark, [(None, 1, "user", "x")]) == set()


def test_windows_in_shares_find_the_same_owners(spark):
    turns = spark.createDataFrame([(c, d, bytes([d * (c < 30 or d < 3)]), 2, d == 5) for c in range(90) for d in range(1, 6)], "conv_id long, depth int, turn_key binary, bytes long, last boolean")
    convs = turns.groupBy("conv_id").count().selectExpr("conv_id", "`count` as length")
    whole, cut = (prefixtrie.prefix_nodes(turns, convs, rows_a_window=n) for n in (10**6, 7))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)


def test_digest_of_many_ids_in_pieces(spark):
    ends = spark.range(1000).selectExpr("cast(1 as long) depth", "id % 2 x1", "cast(5 as long) x2", "id conv_id").repartition(3)
    got = {r.x1: r.ends_sha256 for r in prefixtrie.end_digests(ends, ids_a_piece=7).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, range(k, 1000, 2))).encode()).hexdigest() for k in (0, 1)}


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    name = "op11_conversation_prefix_trie"
    assert oracle.differences(spark, oracle.connect(sf), QUERIES[name], ORACLES[name], sf) is None
