"""Language-model scores by stupid backoff, computed as joins of n-grams with their counts.

Documents are dealt into blocks.  Every block explodes its n-grams (one, two and
three words), adds up equal ones, and sends them, packed by hash partition, to
the count tables: one table per partition, made and asked at the same time.  The
answers (only counts that other blocks add to) return to the block, where the
scores of the words are summed per document.  A very common n-gram arrives once
per block at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairband.llm.common import python_workers
from fairband.llm.mixing import words as word_count
from fairband.llm.shingles import byte_blocks, run_hashes, word_hashes

ORDER = 3
BACKOFF = 0.4
BLOCK_BYTES = 8 << 20  # of text
TABLE_BYTES = 12 << 20  # of text, whose n-grams of one order share a count table
UNSEEN = 0.5  # count of a word that no other document holds
LOW = np.uint64(40)


def all_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and words of each text, made a megabyte at a time."""
    parts = [word_hashes(block) for block in byte_blocks(texts)]
    return np.concatenate([w for w, _ in parts]), np.concatenate([n for _, n in parts])


def gram_keys(words: np.ndarray, counts: np.ndarray, n: int, tables: int) -> np.ndarray:
    """Keys of all runs of ``n`` words: the number of their count table, then 40 bits of the hash.

    Every order has ``tables`` tables of its own, so keys of a higher order are larger.
    """
    h = words if n == 1 else run_hashes(words, counts, n)[0]
    return ((np.uint64((n - 1) * tables) + (h >> LOW) % np.uint64(tables)) << LOW) | (h & np.uint64((1 << 40) - 1))


def _tables(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table numbers in sorted ``keys`` and where each begins, with the end."""
    table = (keys >> LOW).astype(np.int64)
    first = np.flatnonzero(np.diff(table, prepend=-1))
    return table[first], np.append(first, len(keys))


def _pack(low: np.ndarray) -> bytes:
    """Sorted 40-bit numbers as gaps, byte by byte (all lowest bytes first), which compresses best."""
    return np.diff(low, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(packed, np.uint8).reshape(5, -1).T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _pack_counts(n: np.ndarray) -> tuple[bytes, bytes]:
    """Counts in one byte each, and in full those that do not fit."""
    return np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype("<u8").tobytes()


def _unpack_counts(few: bytes, many: bytes) -> np.ndarray:
    n = np.frombuffer(few, np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(many, "<u8")
    return n


def ask(texts: list[bytes], block: int, tables: int) -> pd.DataFrame:
    """A block's distinct n-grams and their counts, one row per count table."""
    words, counts = all_words(texts)
    rows = []
    for order in range(1, ORDER + 1):
        keys, n = np.unique(gram_keys(words, counts, order, tables), return_counts=True)
        table, cut = _tables(keys)
        low = keys & np.uint64((1 << 40) - 1)
        rows += [(block, t, _pack(low[a:b]), *_pack_counts(n[a:b])) for t, a, b in zip(table.tolist(), cut, cut[1:])]
    return pd.DataFrame(rows, columns=["block", "table", "grams", "few", "many"])


def answer(asked: pd.DataFrame) -> pd.DataFrame:
    """Counts over all blocks, returned to each block where they differ from its own."""
    grams = [_unpack(g) for g in asked["grams"]]
    own = [_unpack_counts(few, many) for few, many in zip(asked["few"], asked["many"])]
    _, at = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(own)).astype(np.int64)
    out, begin = [], 0
    for block, table, n in zip(asked["block"], asked["table"], own):
        counted = total[at[begin:begin + len(n)]]
        begin += len(n)
        more = counted != n
        out.append((block, table, np.packbits(more).tobytes(), *_pack_counts(counted[more])))
    return pd.DataFrame(out, columns=["block", "table", "more", "few", "many"])


def _elsewhere(words: np.ndarray, counts: np.ndarray, order: int, answers: dict, tables: int) -> np.ndarray:
    """For every run of ``order`` words of the block: how often documents other than its own hold it."""
    keys, at, n = np.unique(gram_keys(words, counts, order, tables), return_inverse=True, return_counts=True)
    total = n.astype(np.int64)
    for t, a, b in zip(*(lambda table, cut: (table.tolist(), cut, cut[1:]))(*_tables(keys))):
        if t in answers:
            more, few, many = answers[t]
            total[a:b][np.unpackbits(np.frombuffer(more, np.uint8), count=b - a).astype(bool)] = _unpack_counts(few, many)
    owner = np.repeat(np.arange(len(counts)), np.maximum(counts - (order - 1), 0))
    _, mine, own = np.unique(at * len(counts) + owner, return_inverse=True, return_counts=True)
    return (total[at] - own[mine]).astype(float)


def score_block(texts: list[bytes], answers: pd.DataFrame, tables: int, corpus_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log scores of every text, from its block's n-grams and the answers to them."""
    words, counts = all_words(texts)
    by_table = dict(zip(answers["table"], zip(answers["more"], answers["few"], answers["many"])))
    one, two, three = (_elsewhere(words, counts, order, by_table, tables) for order in range(1, ORDER + 1))

    text = np.repeat(np.arange(len(texts)), counts)
    since = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)  # place in the text
    others = np.maximum(corpus_words - counts[text], 1)
    best = np.log(np.maximum(one, UNSEEN)) - np.log(others)
    penalty = np.log(BACKOFF)
    second = np.flatnonzero(since >= 1)  # bigrams end at these words, in the same order
    best[second] = np.where(two > 0, np.log(np.maximum(two, 1)) - np.log(np.maximum(one[second - 1], 1)), penalty + best[second])
    third = np.flatnonzero(since >= 2)
    context = np.cumsum(since >= 1)[third - 1] - 1  # the bigram that ends one word earlier
    best[third] = np.where(three > 0, np.log(np.maximum(three, 1)) - np.log(np.maximum(two[context], 1)), penalty + best[third])
    return counts, np.bincount(text, weights=best, minlength=len(texts))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
              table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Stupid-backoff score of every document under the trigram counts of all other documents.

    Returns one row per input row: ``id_col``, ``n_words``, ``log_score`` (sum over the
    words of the natural log of their score, 0 without words) and ``mean_log_score``
    (null without words).  A word scores count(abc) / count(ab); where no other
    document holds abc, 0.4 times count(bc) / count(b), and then 0.4 times
    count(c) / words.  Words are separated by white space, A-Z count as a-z.  A word that no
    other document holds counts half.  Null texts are empty; rows that repeat an
    id or a text are documents of their own; null ids stay null.  Other columns are
    not read; an empty table gives an empty result.
    """
    python_workers(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sums = texts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(word_count(F.col("text"))).alias("words")).first()
    size, corpus_words = sums["bytes"] or 0, sums["words"] or 0
    blocks, tables = size // block_bytes + 1, size // table_bytes + 6
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    encoded = lambda group: [t.encode() for t in group["text"]]

    def asking(group: pd.DataFrame) -> pd.DataFrame:
        return ask(encoded(group), int(group["block"].iloc[0]), tables)

    def scoring(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        n, scores = score_block(encoded(group), answers, tables, corpus_words)
        return pd.DataFrame({"id": group["id"].astype("Int64"), "n_words": n, "log_score": scores})

    asked = dealt.groupBy("block").applyInPandas(asking, "block long, table long, grams binary, few binary, many binary")
    answers = asked.groupBy("table").applyInPandas(answer, "block long, table long, more binary, few binary, many binary")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(scoring, "id long, n_words long, log_score double")
    return scored.select(F.col("id").alias(id_col), "n_words", F.round("log_score", 6).alias("log_score"),
                         F.round(F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")), 6).alias("mean_log_score"))


QUERY_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS words
  FROM documents
), tokens AS (
  SELECT row, len(words) AS n, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS c,
         unnest([NULL] || words[:len(words) - 1]) AS b, unnest([NULL, NULL] || words[:greatest(len(words) - 2, 0)]) AS a
  FROM (SELECT row, words FROM texts WHERE len(words) > 1)
  UNION ALL
  SELECT row, 1, 1, words[1], NULL, NULL FROM texts WHERE len(words) = 1
), one AS (SELECT c, count(*) AS n FROM tokens GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM tokens WHERE i > 1 GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM tokens WHERE i > 2 GROUP BY a, b, c),
own1 AS (SELECT row, c, count(*) AS n FROM tokens GROUP BY row, c),
own2 AS (SELECT row, b, c, count(*) AS n FROM tokens WHERE i > 1 GROUP BY row, b, c),
own3 AS (SELECT row, a, b, c, count(*) AS n FROM tokens WHERE i > 2 GROUP BY row, a, b, c),
counted AS (
  SELECT t.row, t.i, (SELECT count(*) FROM tokens) - t.n AS others,
         one.n - own1.n AS n_c, b1.n - ob1.n AS n_b, two.n - own2.n AS n_bc, ab.n - oab.n AS n_ab, three.n - own3.n AS n_abc
  FROM tokens t JOIN one ON one.c = t.c JOIN own1 ON own1.row = t.row AND own1.c = t.c
  LEFT JOIN one b1 ON b1.c = t.b LEFT JOIN own1 ob1 ON ob1.row = t.row AND ob1.c = t.b
  LEFT JOIN two ON two.b = t.b AND two.c = t.c LEFT JOIN own2 ON own2.row = t.row AND own2.b = t.b AND own2.c = t.c
  LEFT JOIN two ab ON ab.b = t.a AND ab.c = t.b LEFT JOIN own2 oab ON oab.row = t.row AND oab.b = t.a AND oab.c = t.b
  LEFT JOIN three ON three.a = t.a AND three.b = t.b AND three.c = t.c
  LEFT JOIN own3 ON own3.row = t.row AND own3.a = t.a AND own3.b = t.b AND own3.c = t.c
), scored AS (
  SELECT row, CASE WHEN i > 2 AND n_abc > 0 THEN ln(n_abc) - ln(n_ab)
                   WHEN i > 1 AND n_bc > 0 THEN CASE WHEN i > 2 THEN ln(0.4::DOUBLE) ELSE 0 END + ln(n_bc) - ln(n_b)
                   ELSE least(i - 1, 2) * ln(0.4::DOUBLE) + ln(greatest(n_c, 0.5::DOUBLE)) - ln(greatest(others, 1)) END AS s
  FROM counted
), summed AS (SELECT row, sum(s) AS s FROM scored GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, round(coalesce(s, 0), 6) AS log_score,
       CASE WHEN len(words) > 0 THEN round(s / len(words), 6) END AS mean_log_score
FROM texts LEFT JOIN summed USING (row)
"""
