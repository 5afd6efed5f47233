import hashlib
from collections import defaultdict

from fairband.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from llm_rows import edge_documents, edge_rows, empty_documents, rows, with_clashes


def brute(data):
    groups = defaultdict(list)
    for doc_id, text, *_ in data:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        groups[hashlib.sha256(low.encode()).hexdigest()].append(doc_id)
    out = []
    for digest, ids in groups.items():
        best = max(ids, key=lambda i: (i is not None, i or 0))
        kept = False
        for i in ids:
            out.append((i, best, len(ids), i == best and not kept, digest))
            kept |= i == best
    return sorted(out, key=repr)


def test_against_brute_force_with_a_full_filter_and_a_roomy_one(spark):
    docs = edge_documents(spark)
    for options in ({}, {"max_filter_bits": 1}, {"salts": 2}):
        assert rows(exact_duplicates(docs, **options)) == brute(edge_rows())


def test_hot_group_and_clashing_names(spark):
    data = edge_rows() + [(1000 + i, "Copy OF this", "en", "a", 1) for i in range(500)]
    docs = with_clashes(spark.createDataFrame(data, edge_documents(spark).schema), "digest", "row", "block", "keep_id", "_salt")
    assert rows(exact_duplicates(docs)) == brute(data)


def test_empty_table(spark):
    out = exact_duplicates(empty_documents(spark))
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0


def test_survivors_keep_their_columns_and_repeated_rows_leave_one(spark):
    docs = edge_documents(spark)
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((r[0] for r in brute(edge_rows()) if r[3]), key=repr)
