import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from fairband.llm import prefix_trie
from fairband.llm.queries import ORACLE, QUERIES
from llm_rows import with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(data):
    """Nodes by walking every rebuilt conversation, subtrees by recursion over sets."""
    own = defaultdict(list)
    for conv, turn, role, text in data:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, below = [], {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(below[k][0] for k in children[p]) or 1
        saved = sum(below[k][1] for k in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        below[p] = leaves, saved
        ends = ",".join(str(c) for c in members[p] if len(built[c]) == len(p))
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(df, **kw):
    conv = F.col("conv_id")
    turns = prefix_trie.turn_table(df, conv - conv % 5, F.crc32(conv.cast("string")) % 9)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(turns, **kw).select(*NAMES).collect()), key=repr)


def sample(seed, conversations=120, words=3):
    rng = random.Random(seed)
    data = []
    for c in rng.sample(range(-20, 3 * conversations), conversations):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            data.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["é", "b c", "long text"][:words]) if t > 2 else "hello"))
    return data


def test_random_conversations_in_one_and_many_shards(spark):
    for seed in range(2):
        data = sample(seed)
        random.Random(9).shuffle(data)
        df = spark.createDataFrame(data, SCHEMA)
        want = brute(data)
        assert trie(df) == want
        assert trie(df, shard_turns=8) == want


def test_awkward_rows(spark):
    data = [(0, None, None, None), (0, 0, "user", None), (0, 1, "", ""), (0, 1, "", ""), (0, None, "user", "x"), (None, 1, "user", "lost"),
            (7, 5, "user", "alone"), (-3, 1, "user", "below"), (-5, 1, "user", "base"), (-9, 0, "a", "of -5"), (-9, 1, "a", "b" * 50_000),
            (10**15, 0, "user", "far"), (3, 1, "us", "er"), (3, 1, "user", ""), (3, 2, None, "naïve \U0001f600")]
    data += [(2, t, "user", str(t % 3)) for t in range(60)]
    df = with_clashes(spark.createDataFrame(data, SCHEMA), "node", "parent", "depth", "family", "conv", "shard", "n_convs")
    assert trie(df) == brute(data)
    assert trie(df, shard_turns=1) == brute(data)
    assert trie(df.limit(0)) == []
    assert trie(df.filter("conv_id is null")) == []


def test_copies_of_one_conversation_over_many_shards(spark):
    data = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(6)] + [(c, 0, "user", "turn 0") for c in range(400, 430)]
    df = spark.createDataFrame(data, SCHEMA)
    assert trie(df, shard_turns=20) == brute(data)


def test_shard_is_a_bitmap_index():
    shard = prefix_trie.Shard([(3, [b"a", b"b"], [1, 1]), (5, [b"a"], [1]), (9, [], []), (12, [b"a", b"c"], [1, 2])])
    assert shard.postings == [{b"a": 0b1011}, {b"b": 0b0001, b"c": 0b1000}]
    assert shard.ending == {2: 0b1001, 1: 0b0010, 0: 0b0100}
    assert shard.members(0b1010) == [5, 12]
    rows = {(n[2], n[3]): n[4:] for n in shard.walk()}
    assert rows[0, 3] == [4, 0, 6, 4, 2, 0, "9"] and rows[1, 3] == [3, 1, 6, 4, 2, 0, "5"] and rows[2, 12] == [1, 2, 2, 2, 1, 1, "12"]


def test_query_against_sql_and_brute_force(spark, sf_dir):
    got = QUERIES["op12_prefix_trie"](spark, sf_dir)
    path = f"{sf_dir}/conversations.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    sql = db.execute(ORACLE["op12_prefix_trie"])
    names = [c[0] for c in sql.description]
    rows = sorted((tuple(r) for r in got.select(*names).collect()), key=repr)
    assert rows == sorted((tuple(r) for r in sql.fetchall()), key=repr)
    data = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(path).collect()]
    assert sorted((tuple(r) for r in got.select(*NAMES).collect()), key=repr) == brute(data)
