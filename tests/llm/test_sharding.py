import random
import zlib
from collections import defaultdict

import pytest

from fairband.llm import sharding
from llm_rows import SCHEMA, edge_documents, edge_rows, empty_documents, with_clashes


def check(out, data, shards, slack):
    got = [tuple(r) for r in out.collect()]
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data), key=repr)
    assert sorted((r[:3] for r in got), key=repr) == want
    slots, sizes = defaultdict(list), [0] * shards
    for _, size, _, shard, slot in got:
        slots[shard].append(slot)
        sizes[shard] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(s - sum(sizes) / shards) <= slack for s in sizes), sizes
    return got


def test_edge_rows(spark):
    data = edge_rows()
    longest = max(len((r[1] or "").encode()) for r in data)
    docs = with_clashes(edge_documents(spark), "size", "shard", "slot", "text_hash", "cell_id")
    check(sharding.assign_shards(docs, 3), data, 3, longest + 1)


@pytest.mark.parametrize("probes", [4096, 5])
def test_hot_text_is_cut_and_small_groups_stay_together(spark, probes):
    data = [(i, "the same text", "en", "a", 1) for i in range(3000)] + [(5000 + i, f"text {i // 3} {'z' * (i // 3 % 40)}", "en", "a", 1) for i in range(2000)]
    docs = spark.createDataFrame(data, SCHEMA)
    keys = sharding.written(sharding.sharding_keys(docs, "doc_id", "text"), "t")
    splitters = sharding.find_splitters(keys, 8, probes=probes)
    assert len(splitters) == 7
    got = check(sharding.assign_shards(docs, 8), data, 8, 0.02 * sum(len(r[1]) + 1 for r in data) / 8)
    homes = defaultdict(set)
    for _, _, crc, shard, _ in got:
        homes[crc].add(shard)
    assert sum(len(h) > 1 for h in homes.values()) == 1


def test_fewer_rows_than_shards_and_none(spark):
    data = [(1, None, "en", "a", 1), (2, "b", "en", "a", 1)]
    assert sharding.assign_shards(spark.createDataFrame(data, SCHEMA), 8).count() == 2
    assert sharding.assign_shards(empty_documents(spark), 8).count() == 0


def test_reruns_agree_and_written_shards_hold_every_row(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = sorted(map(tuple, sharding.assign_shards(docs).collect()))
    assert first == sorted(map(tuple, sharding.assign_shards(docs.repartition(7)).collect()))
    sharding.write_shards(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.collect()) == sorted((r[0], r[3], r[4]) for r in first)


@pytest.mark.parametrize("seed", [0, 1])
def test_shards_are_ranges_of_the_sorted_keys(spark, seed):
    """Brute force: sort all keys, add up their sizes, and look where the boundaries had to be."""
    rng = random.Random(seed)
    data = [(i, "x" * rng.choice([0, 3, 40, 900]) + str(rng.randrange(400)), "en", "a", 1) for i in range(1500)]
    docs = spark.createDataFrame(data, SCHEMA)
    order = sorted((r.text_hash, r.id_hash, r.id, r.size) for r in sharding.sharding_keys(docs, "doc_id", "text").collect())
    placed = {r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(docs, 6).collect()}
    shards = [placed[i][0] for *_, i, _ in order]
    assert shards == sorted(shards) and set(shards) == set(range(6))
    first = {s: shards.index(s) for s in set(shards)}
    assert all(sorted(slot for shard, slot in placed.values() if shard == s) == list(range(shards.count(s))) for s in first)
    total = sum(size for *_, size in order)
    for cut in range(1, 6):
        below = sum(size for *_, size in order[:first[cut]])
        goal, groups, at = total * cut // 6, [], 0
        for n, (text, *_, size) in enumerate(order):  # sums before every group of equal texts, and after the last
            if n == 0 or text != order[n - 1][0]:
                groups.append(at)
            at += size
        best = min(abs(g - goal) for g in [*groups, at])
        assert abs(below - goal) <= max(best, 0.01 * total / 6, 1), (cut, below, goal, best)


def test_written_shards_hold_repeated_and_null_ids_once_each(spark, tmp_path):
    data = edge_rows() + [(11, "other text", "en", "b", 1), (None, None, None, None, None)]
    docs = with_clashes(spark.createDataFrame(data, SCHEMA), "row", "size", "text_hash", "_inside", "_offset", "shard")
    sharding.write_shards(docs, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    names = ["doc_id", "text", "lang", "source", "n_chars", "row", "size"]
    assert sorted(map(tuple, back.select(names).collect()), key=repr) == sorted(map(tuple, docs.select(names).collect()), key=repr)
    slots = defaultdict(list)
    for r in back.select("shard", "slot").collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
