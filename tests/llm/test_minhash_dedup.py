import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from fairband.llm import minhash_dedup as M
from fairband.llm.shingles import run_hashes, shingle_sets, text_blocks, word_hashes
from llm_rows import SCHEMA, edge_documents, edge_rows, empty_documents, with_clashes


def brute(data, similarity=M.SIMILARITY):
    """Classes over all pairs of documents, by plain sets of words."""
    sets, cells, n = {}, np.zeros(1 << M.CELL_BITS, np.int64), 0
    for k, (_, text, *_) in enumerate(data):
        h, tf, c = shingle_sets([(text or "").encode()], M.WORDS)
        if c[0]:
            sets[k], n = (h, tf), n + 1
            cells += np.bincount((h >> np.uint64(64 - M.CELL_BITS)).astype(np.int64), minlength=len(cells))
    weights = M.Weights(cells, n)
    packed = {k: (h.tobytes(), weights.of(h, tf).tobytes()) for k, (h, tf) in sets.items()}
    parent = {k: k for k in range(len(data))}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(packed)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if M.weighted_jaccard(*packed[a], *packed[b]) >= similarity:
                parent[root(a)] = root(b)
    by_id = defaultdict(list)
    for k in keys:
        by_id[data[k][0]].append(k)
    classes = defaultdict(list)
    for k in range(len(data)):
        classes[root(k)].append(k)
    low = lambda i: (i is not None, i or 0)
    out = []
    for ks in classes.values():
        first = min((data[k][0] for k in ks), key=low)
        out += [(data[k][0], first, len(ks), data[k][0] == first) for k in ks]
    return sorted(out, key=repr)


def near_copies(seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    data = edge_rows()
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.choice([30, 120, 400]))
        for member in range(rng.choice([2, 3, 8, 25])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 45))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            data.append((1000 + 100 * family + member, " ".join(words), "en", "a", 1))
    return data


def test_against_brute_force(spark):
    data = near_copies()
    docs = with_clashes(spark.createDataFrame(data, SCHEMA), "doc", "id", "class", "label", "digest", "key")
    got = sorted((tuple(r) for r in M.near_duplicates(docs).collect()), key=repr)
    assert got == brute(data)


def test_documents_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in M.near_duplicates(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_hot_copies_and_survivors(spark):
    data = [(i, "one text that very many rows hold in the same words", "en", "a", 1) for i in range(3000)] + near_copies(1)
    docs = spark.createDataFrame(data, SCHEMA)
    left = M.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    kept = {r.doc_id for r in left.collect()}
    assert kept & set(range(3000)) >= {0} and not kept & {20, 30, 2999}


def related_documents(members, pairs):
    """One family about 0.79 alike, in which the first members are 0.82 alike two by two."""
    rng = random.Random(3)
    fresh = lambda n: ["w%d" % rng.randrange(10 ** 9) for _ in range(n)]
    base, shared, data = fresh(320), [], []
    for member in range(members):
        if member % 2 == 0:
            shared = fresh(6)
        own = shared + fresh(26) if member < 2 * pairs else fresh(32)
        data.append((member, " ".join(base + own), "en", "a", 1))
    return data


def test_similar_pairs_among_many_related_documents(spark):
    data = related_documents(240, 20)
    got = sorted((tuple(r) for r in M.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()), key=repr)
    assert got == brute(data) and sum(r[2] == 2 for r in got) == 40


def test_similar_pairs_in_buckets_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_PART", 16)
    data = related_documents(120, 20)
    got = sorted((tuple(r) for r in M.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()), key=repr)
    assert got == brute(data) and sum(r[2] == 2 for r in got) == 40


def test_all_parts_of_a_bucket_meet_once(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_PART", 10)
    searched = spark.createDataFrame([(7, i, 0 if i < 40 else i) for i in range(70)] + [(8, i, 5) for i in range(30)], "key long, id long, label long")
    met = defaultdict(int)
    groups = defaultdict(list)
    for r in M.visits(searched, M.MIXED).collect():
        groups[r.key, r.one, r.other].append(r)
    for (key, one, other), rows in groups.items():
        assert key == 7
        for i, a in enumerate(rows):
            for b in rows[:i]:
                met[min(a.id, b.id), max(a.id, b.id)] += one == other or a.part != b.part
    assert all(met[i, j] == 1 for j in range(40, 70) for i in range(j))


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(2)
    h = np.sort(rng.integers(0, 1 << 64, 400, dtype=np.uint64))
    agreed, true = [], None
    for trial in range(60):
        keys = np.sort(rng.integers(0, 1 << 64, 130, dtype=np.uint64))
        w = rng.choice([0.8, 1.0, 1.7, 2.1], 130).astype(np.float32)
        a, b = np.arange(130) < 110, np.arange(130) >= 20
        true = np.concatenate(([] if true is None else true, [w[a & b].sum() / w.sum()]))
        one, other = (M.samples(keys[m], w[m], np.array([m.sum()]))[0] for m in (a, b))
        agreed.append((one == other).mean())
    assert abs(np.mean(agreed) - true.mean()) < 0.02
    assert len(h) == 400


def test_sketches_bound_the_similarity_from_above():
    rng = np.random.default_rng(4)
    for size in (1, 5, 150, 3000):
        for _ in range(20):
            keys = np.sort(rng.integers(0, 1 << 64, 2 * size, dtype=np.uint64))
            w = rng.choice([0.75, 0.9, 1.0, 1.7, 5.0], 2 * size).astype(np.float32)
            a, b = (rng.random(2 * size) < rng.choice([0.3, 0.9, 1.0]) for _ in range(2))
            if a.any() and b.any():
                bounds = [M.bound_sketches(keys[m], w[m], np.array([m.sum()])) for m in (a, b)]
                true = M.weighted_jaccard(keys[a].tobytes(), w[a].tobytes(), keys[b].tobytes(), w[b].tobytes())
                assert M.most_alike(*bounds)[0] >= true
    one, other = np.sort(rng.integers(0, 1 << 64, 146, dtype=np.uint64)), np.sort(rng.integers(0, 1 << 64, 40, dtype=np.uint64))
    mix = np.sort(np.concatenate([one[40:], other]))  # 106 of 186 in common
    w = np.ones(146, np.float32)
    assert M.most_alike(*[M.bound_sketches(h, w, np.array([146])) for h in (one, mix)])[0] < 0.75


def test_a_pair_is_named_in_its_first_band_only(spark):
    docs = spark.createDataFrame(related_documents(60, 20), SCHEMA).select(F.col("doc_id").alias("doc"), "text")
    weights = spark.sparkContext.broadcast(M.Weights(*M.cell_frequencies(docs)))
    signed = M.signatures(docs, weights).collect()
    drawn = np.frombuffer(b"".join(r.samples for r in signed), np.uint32).reshape(-1, M.SAMPLES)
    keys = [r.keys for r in spark.createDataFrame(signed).select(F.array(*M.band_keys(F.col("samples"))).alias("keys")).collect()]
    assert all((k >> 60) & 15 == band for row in keys for band, k in enumerate(row))
    for i in range(60):
        for j in range(i):
            shared = [b for b in range(M.BANDS) if keys[i][b] == keys[j][b]]
            bounds = np.frombuffer(signed[i].sketch + signed[j].sketch, M._BOUND)
            named = [b for b in shared if M.hopeful(drawn[[i, j]], bounds, np.array([0]), np.array([1]), b, 0.0)[0]]
            assert named == shared[:1]


def test_word_and_run_hashes_follow_the_words():
    texts = [b"The cat  sat\n", b"", b" \t", b"the CAT sat on", b"cat sat"]
    words, counts = word_hashes(texts)
    assert counts.tolist() == [3, 0, 0, 4, 2] and (words[:3] == words[3:6]).all() and len(set(words.tolist())) == 4
    runs, made = run_hashes(words, counts, 2)
    assert made.tolist() == [2, 0, 0, 3, 1] and (runs[:2] == runs[2:4]).all() and runs[5] == runs[1]
    assert [len(b) for b in text_blocks(["a"] * 3)] == [3] and list(text_blocks([])) == []


def test_propagated_labels(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 90), (90, 95), (7, 3)]
    got = {r.id: r.label for r in M.propagate(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert M.propagate(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_empty_table(spark):
    assert M.near_duplicates(empty_documents(spark)).count() == 0
    assert M.near_duplicates(edge_documents(spark).filter(F.col("doc_id") < 4)).count() == 3
