"""Near duplicates: weighted MinHash over TF-IDF shingles, banded and verified.

1. Document frequencies of five-word shingles are counted in hash cells.
2. Improved consistent weighted sampling (Ioffe) draws ``BANDS`` x ``ROWS`` samples
   per document; two documents share a sample with the probability of their
   weighted Jaccard similarity.  Equal shingle sets become one representative.
3. Representatives that share a band meet in its bucket.  Nobody is paired with a
   whole bucket: every member names the few members of other classes whose samples
   agree most with its own, found in blocks.  A pair is named only in the first
   bucket that both share, and only if it can be similar: the weights that fall
   into ``BOUND_CELLS`` hash cells bound the common weight from above.  Those pairs are
   verified by exact weighted Jaccard.
4. Verified links make classes by label propagation.  Members of larger buckets
   that had more such partners than they could name then name more of them outside
   their class, until nobody has further ones.  Very large buckets are searched in
   random parts for ``MIXED`` rounds, so that families of copies become classes, and
   then in all pairs of parts that can hold a pair of two classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairband.llm.common import aside, discard, give_back, maybe_among, python_workers, written
from fairband.llm.shingles import mixed, shingle_sets, text_blocks

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 3
SAMPLES = BANDS * ROWS
AGREEING = 23  # of 42 samples, that a pair needs to be verified; 0.8 alike pairs have 33.6 on average, standard deviation 2.6
PARTNERS, MORE = 6, 4  # partners that a member names in the first round, and how many times as many in each later one
BUCKET_PART, MIXED = 4096, 2  # members that are compared at a time, and rounds in random parts only
BOUND_CELLS = 128  # cells of the upper bound of a pair's common weight
NO_ID = -(1 << 63)
CELL_BITS = 18
FLOOR = 0.01  # document frequencies below this share of all documents count as this share
LEAST_IDF = 0.75  # weight of a shingle that every document holds

_DRAWS = np.random.Generator(np.random.PCG64(5))
_MULTIPLIER = _DRAWS.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), at the middles of n equal parts."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(70):
        middle = (low + high) / 2
        below = -np.expm1(-middle) - middle * np.exp(-middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


_R = _gamma_quantiles(1 << 11).astype(np.float32)
_LOG_C = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)


class Weights:
    """TF-IDF weights: (1 + ln tf) times an inverse document frequency between ``LEAST_IDF`` and 1.

    Frequencies are those of hash cells.  The floor lies well above what unrelated
    shingles add up to in a cell, so most shingles weigh the same, and members of a
    large family of copies lose little of their likeness.
    """

    def __init__(self, cells: np.ndarray, documents: int):
        floor = max(FLOOR * documents, 5 * cells.sum() / len(cells), 1.0)
        top = max(np.log(max(documents, 1) / floor), 1e-9)
        idf = np.clip(np.log(max(documents, 1) / np.maximum(cells, floor)) / top, 0, 1)
        self.idf = np.where(cells <= floor, 1.0, LEAST_IDF + (1 - LEAST_IDF) * idf).astype(np.float32)

    def of(self, hashes: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return self.idf[hashes >> np.uint64(64 - CELL_BITS)] * (1 + np.log(tf)).astype(np.float32)


def samples(hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``SAMPLES`` consistent weighted samples of every non-empty set, as 32-bit names.

    For each shingle and sample, r and c are Gamma(2, 1) and b is uniform, all
    functions of the shingle; t = floor(ln w / r + b), and the shingle with least
    ln a = ln c - r (t - b) - r is drawn, named together with t.
    """
    starts = np.cumsum(counts) - counts
    log_w = np.log(weights)
    odd = np.flatnonzero(log_w != 0)
    out = np.empty((len(counts), SAMPLES), np.uint32)
    name = mixed(hashes).astype(np.uint32).astype(np.int64)
    for k in range(SAMPLES):
        z = hashes * _MULTIPLIER[k]
        z ^= z >> np.uint64(29)
        z *= np.uint64(0x9E3779B97F4A7C15)
        r = _R[(z >> np.uint64(20)).astype(np.uint32) & np.uint32(2047)]
        b = ((z >> np.uint64(32)).astype(np.uint32) & np.uint32(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
        log_c = _LOG_C[z >> np.uint64(48)]
        value = log_c - r * (1 - b)  # weight 1: t = 0
        named = name
        if len(odd):
            t = np.floor(log_w[odd] / r[odd] + b[odd])
            value[odd] = log_c[odd] - r[odd] * (t - b[odd] + 1)
            named = name.copy()
            named[odd] = (named[odd] + t.astype(np.int64) * 0x9E3779B1) & 0xFFFFFFFF
        bits = value.view(np.int32)
        rank = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64)  # ordered as the floats are
        out[:, k] = np.minimum.reduceat((rank << 32) | named, starts).astype(np.uint32)
    return out


def cell_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by hash cell of their shingles, and documents with words; the cells are fixed in number."""
    block = 1 << 12

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        cells, documents = np.zeros(1 << CELL_BITS, np.int64), 0
        for batch in batches:
            for texts in text_blocks(batch["text"]):
                hashes, _, counts = shingle_sets(texts, WORDS)
                cells += np.bincount((hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=len(cells))
                documents += int((counts > 0).sum())
        parts = cells.reshape(-1, block)
        yield pd.DataFrame({"part": np.arange(-1, len(parts)), "lot": TaskContext.get().partitionId() % 256,
                            "counts": [np.array([documents]).tobytes(), *(p.tobytes() for p in parts)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in group["counts"])
        return pd.DataFrame({"part": group["part"].iloc[:1], "lot": 0, "counts": [total.tobytes()]})

    schema = "part int, lot int, counts binary"
    counted = docs.select("text").mapInPandas(count, schema).groupBy("part", "lot").applyInPandas(add, schema)
    got = {r["part"]: np.frombuffer(r["counts"], np.int64) for r in counted.groupBy("part").applyInPandas(add, schema).collect()}
    cells = np.concatenate([got[p] for p in range(len(got) - 1)]) if got else np.zeros(1 << CELL_BITS, np.int64)
    return cells, int(got[-1][0]) if got else 0


def _set_names(hashes: np.ndarray, tf: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit digest of every set with its counts: equal sets, and only those, share it."""
    both, ends = np.stack((hashes, tf.astype(np.uint64)), axis=1), np.cumsum(counts)
    digests = [hashlib.blake2b(both[e - c:e].tobytes(), digest_size=8).digest() for e, c in zip(ends, counts)]
    return np.frombuffer(b"".join(digests), np.int64)


def _sets(batch: pd.DataFrame) -> Iterator[tuple]:
    """Ids, names, shingles, counts and sizes of the documents with words, block by block."""
    at = 0
    for texts in text_blocks(batch["text"]):
        ids = batch["doc"].to_numpy()[at:at + len(texts)]
        at += len(texts)
        hashes, tf, counts = shingle_sets(texts, WORDS)
        some = counts > 0
        if some.any():
            yield ids[some], _set_names(hashes, tf, counts[some]), hashes, tf, counts[some]


_BOUND = np.dtype([("unit", "<f4"), ("total", "<f4"), ("cells", np.uint8, BOUND_CELLS)])


def bound_sketches(hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For every set its total weight, and its weight in each hash cell, rounded up to 255ths of the largest."""
    owner = np.repeat(np.arange(len(counts)), counts)
    cell = (hashes >> np.uint64(64 - (BOUND_CELLS - 1).bit_length())).astype(np.int64)
    sums = np.bincount(owner * BOUND_CELLS + cell, weights, len(counts) * BOUND_CELLS).reshape(-1, BOUND_CELLS)
    out = np.empty(len(counts), _BOUND)
    out["unit"], out["total"] = sums.max(axis=1) / 255, sums.sum(axis=1)
    out["cells"] = np.minimum(255, np.ceil(sums / out["unit"][:, None]))
    return out


def most_alike(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """An upper bound of the similarity of each pair of sketches."""
    a, b = one["cells"] * one["unit"][:, None], other["cells"] * other["unit"][:, None]
    common = np.minimum(np.minimum(a, b).sum(axis=1) * np.float32(1 + 1e-4), np.minimum(one["total"], other["total"]))
    return common / (one["total"] + other["total"] - common) * np.float32(1 + 1e-4)  # float rounding never lowers it


def signatures(docs: DataFrame, weights) -> DataFrame:
    """``(doc, id, samples, sketch)`` of every document with words; ``id`` names its shingle set."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for batch in batches:
            for ids, names, hashes, tf, counts in _sets(batch):
                w = weights.value.of(hashes, tf)
                drawn, bounds = samples(hashes, w, counts), bound_sketches(hashes, w, counts)
                yield pd.DataFrame({"doc": ids, "id": names, "samples": [row.tobytes() for row in drawn], "sketch": [row.tobytes() for row in bounds]})
        give_back()

    return docs.select("doc", "text").mapInPandas(sign, "doc long, id long, samples binary, sketch binary")


def weighted_sets(docs: DataFrame, weights) -> DataFrame:
    """``(id, hashes, weights)``: sorted shingles and their weights, packed."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back()
        for batch in batches:
            for _, names, hashes, tf, counts in _sets(batch):
                w, ends = weights.value.of(hashes, tf), np.cumsum(counts)
                yield pd.DataFrame({"id": names, "hashes": [hashes[e - c:e].tobytes() for e, c in zip(ends, counts)],
                                    "weights": [w[e - c:e].tobytes() for e, c in zip(ends, counts)]})
        give_back()

    return docs.select("doc", "text").mapInPandas(pack, "id long, hashes binary, weights binary")


def weighted_jaccard(h1: bytes, w1: bytes, h2: bytes, w2: bytes) -> float:
    a, b = np.frombuffer(h1, np.uint64), np.frombuffer(h2, np.uint64)
    wa, wb = np.frombuffer(w1, np.float32).astype(float), np.frombuffer(w2, np.float32).astype(float)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum()
    return float(both / (wa.sum() + wb.sum() - both))


@F.pandas_udf(T.IntegerType())
def agreeing(one: pd.Series, other: pd.Series) -> pd.Series:
    """Samples that two documents share."""
    a, b = (np.frombuffer(b"".join(x), np.uint32).reshape(-1, SAMPLES) for x in (one, other))
    return pd.Series((a == b).sum(axis=1))


@F.pandas_udf(T.DoubleType())
def likeness(h1: pd.Series, w1: pd.Series, h2: pd.Series, w2: pd.Series) -> pd.Series:
    return pd.Series([weighted_jaccard(*x) for x in zip(h1, w1, h2, w2)], dtype=float)


def band_keys(column: Column) -> list[Column]:
    """A key for every band: its number in the four highest bits, and a hash of its samples."""
    return [F.shiftleft(F.lit(k).cast("long"), 60).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.substring(column, 4 * ROWS * k + 1, 4 * ROWS)), 4))
            for k in range(BANDS)]


def propagate(links: DataFrame, name: str) -> DataFrame:
    """``(id, label, ...)`` of every linked id: the smallest id reachable over ``(a, b)`` links.

    Every step takes the smallest label of the neighbours, then the label's own
    label, so long chains shorten twice as fast each time.
    """
    sides = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-sides")
    labels = written(sides.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("label"), F.lit(True).alias("changed")), f"{name}-labels")
    while labels.filter("changed").limit(1).count():
        heard = (sides.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id"))
                 .agg(F.min("label").alias("heard")))
        nearer = labels.select("id", F.col("label").alias("old")).join(heard, "id").select("id", "old", F.least("old", "heard").alias("label"))
        above = nearer.select(F.col("id").alias("label"), F.col("label").alias("next"))
        before, labels = labels, written(nearer.join(above, "label", "left").select(
            "id", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
            .select("id", "label", (F.col("label") < F.col("old")).alias("changed")), f"{name}-labels")
        discard(before)
    discard(sides)
    return labels


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` that are similar."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("hashes").alias(f"hashes_{side}"),
                                       F.col("weights").alias(f"weights_{side}")), side)
    return (pairs.withColumn("similarity", likeness("hashes_a", "weights_a", "hashes_b", "weights_b"))
            .filter(F.col("similarity") >= similarity).select("a", "b"))


def hopeful(drawn: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray, band: int, similarity: float) -> np.ndarray:
    """Which pairs of rows meet in no band before ``band`` and can be similar."""
    out = np.empty(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        i, j = a[at:at + (1 << 16)], b[at:at + (1 << 16)]
        first = (drawn[i, :band * ROWS] == drawn[j, :band * ROWS]).reshape(-1, band, ROWS).all(axis=2).any(axis=1) if band else np.zeros(len(i), bool)
        out[at:at + len(i)] = ~first
        rest = np.flatnonzero(~first)
        out[at + rest] = most_alike(bounds[i[rest]], bounds[j[rest]]) >= similarity
    return out


def best_partners(ids: np.ndarray, labels: np.ndarray, drawn: np.ndarray, most: int, parts: np.ndarray | None = None,
                  bounds: np.ndarray | None = None, band: int = 0, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """For each document the up to ``most`` of other classes whose samples agree most, if enough: ``(a, b)`` rows.

    With ``bounds`` only ``hopeful`` pairs count.  With ``parts`` they are of another part, too.  Members of the commonest class
    name nobody, the others name them.  The second result marks the documents
    between which pairs are left: those with more partners than ``most``, and then
    the commonest class.
    """
    _, numbers = np.unique(labels, return_inverse=True)
    common = numbers == np.bincount(numbers).argmax()
    naming, left = np.flatnonzero(~common), np.zeros(len(ids), bool)
    found, k = [np.empty((0, 2), np.int64)], min(most, len(ids))
    for at in range(0, len(naming), 256):
        rows = naming[at:at + 256]
        agreed = np.zeros((len(rows), len(ids)), np.uint8)
        for column in drawn.T:
            agreed += column[rows, None] == column[None, :]
        agreed[labels[rows, None] == labels[None, :]] = 0
        if parts is not None:
            agreed[parts[rows, None] == parts[None, :]] = 0
        if bounds is not None:
            i, j = np.nonzero(agreed >= AGREEING)
            agreed[i, j] *= hopeful(drawn, bounds, rows[i], j, band, similarity)
        top = np.argpartition(agreed, len(ids) - k, axis=1)[:, len(ids) - k:]
        i, j = np.nonzero(np.take_along_axis(agreed, top, axis=1) >= AGREEING)
        found.append(np.stack((ids[rows[i]], ids[top[i, j]]), axis=1))
        left[rows] = (agreed >= AGREEING).sum(axis=1) > most
    return np.concatenate(found), left | (common & left.any())


def _within_small(members: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs with enough agreeing samples in the buckets in which nobody has more than ``PARTNERS`` others."""
    before = Window.partitionBy("key").orderBy("id").rowsBetween(-PARTNERS, -1)
    pairs = (members.filter(F.col("size") <= PARTNERS + 1).withColumn("b", F.collect_list("id").over(before))
             .select(F.col("id").alias("a"), F.explode("b").alias("b")).distinct())
    one = known.select(F.col("id").alias("a"), F.col("samples").alias("samples_a"))
    other = known.select(F.col("id").alias("b"), F.col("samples").alias("samples_b"))
    return (pairs.join(one, "a").join(other, "b").filter(agreeing("samples_a", "samples_b") >= AGREEING)
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))


def visits(searched: DataFrame, turn: int) -> DataFrame:
    """``(key, id, label, part, one, other, more)``: the members that are compared at a time, by key and pair of parts.

    For ``MIXED`` rounds parts are drawn anew and only their own members meet; ``more``
    tells that a bucket has further parts.  Then every pair of parts meets once but
    those within the commonest class, whose members get parts of their own.  Buckets
    of a single class have nothing left to find.
    """
    counts = searched.groupBy("key", "label").agg(F.count("*").alias("n"))
    facts = counts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("common"), F.sum("n").alias("size")).filter("common.n < size")
    rows, lot = searched.join(facts, "key"), F.xxhash64("id", F.lit(turn))
    if turn < MIXED:
        parts = F.ceil(F.col("size") / BUCKET_PART)
        part = F.pmod(lot, parts)
        return rows.select("key", "id", "label", part.alias("part"), part.alias("one"), part.alias("other"), (parts > 1).alias("more"))
    pieces = lambda n: F.ceil(n / max(1, BUCKET_PART // 2))
    split = F.col("size") > BUCKET_PART
    rows = (rows.withColumn("others", F.when(split, pieces(F.col("size") - F.col("common.n"))).otherwise(1))
            .withColumn("commons", F.when(split, pieces(F.col("common.n"))).otherwise(0))
            .withColumn("part", F.when(split & (F.col("label") == F.col("common.label")), F.col("others") + F.pmod(lot, F.col("commons")))
                        .otherwise(F.pmod(lot, F.col("others"))))
            .withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("part") < F.col("others"), F.col("others") + F.col("commons"))
                                                    .otherwise(F.col("others")) - 1))))
    return rows.select("key", "id", "label", "part", F.least("part", "met").alias("one"), F.greatest("part", "met").alias("other"),
                       F.lit(False).alias("more"))


def _within_large(members: DataFrame, known: DataFrame, labels: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Best partners ``(key, a, b)`` in the other buckets, and ``(key, a, a)`` of the members that may have further ones."""
    most = PARTNERS * MORE ** turn

    def search(group: pd.DataFrame) -> pd.DataFrame:
        drawn = np.frombuffer(b"".join(group["samples"]), np.uint32).reshape(-1, SAMPLES)
        ids, first = group["id"].to_numpy(), group.iloc[0]
        parts = group["part"].to_numpy() if first["one"] != first["other"] else None
        bounds = np.frombuffer(b"".join(group["sketch"]), _BOUND)
        pairs, left = best_partners(ids, group["label"].to_numpy(), drawn, most, parts, bounds, int(first["band"]), similarity)
        left |= first["more"]
        pairs = pd.DataFrame({"a": pairs.max(axis=1), "b": pairs.min(axis=1)}).drop_duplicates()
        return pd.concat([pairs, pd.DataFrame({"a": ids[left], "b": ids[left]})]).assign(key=first["key"])[["key", "a", "b"]]

    searched = members.select("key", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    return (visits(searched, turn).withColumn("band", F.shiftright("key", 60).bitwiseAND(F.lit(15)).cast("int")).join(known, "id")
            .groupBy("key", "one", "other").applyInPandas(search, "key long, a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Classes of texts whose TF-IDF weighted five-word shingles have a Jaccard similarity of ``similarity`` or more.

    Returns one row per input row: ``id_col``, ``class_id`` (smallest id of the class),
    ``class_size`` (rows) and ``kept`` (the one document of its class that stays,
    the smallest id).  Classes are connected over similar pairs.  Words are separated by
    white space, A-Z count as a-z.  Texts of fewer than five words are one shingle;
    texts without words, null ones too, are classes of their own.  Rows that repeat
    an id are one document and share its fate; a null id counts as the smallest.
    Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    python_workers(spark)
    texts = docs.select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    weights = spark.sparkContext.broadcast(Weights(*cell_frequencies(texts)))
    signed = written(signatures(texts, weights), "near-signatures")
    reps = written(signed.groupBy("id").agg(F.min("doc").alias("doc"), F.count("*").alias("documents"), F.first("samples").alias("samples"),
                                                F.first("sketch").alias("sketch"))
                   .withColumn("keys", F.array(*band_keys(F.col("samples")))), "near-representatives")
    banded = reps.select("id", "doc", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = written(banded.join(buckets, "key"), "near-members")
    wanted = written(members.groupBy("id").agg(F.first("doc").alias("doc")), "near-wanted")
    known = written(reps.join(wanted.select("id"), "id", "left_semi").select("id", "samples", "sketch"), "near-known")
    asked = written(wanted.select("doc").distinct(), "near-asked")
    sets = written(weighted_sets(maybe_among(texts, asked, "doc").join(asked, "doc", "left_semi"), weights)
                   .join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"]), "near-sets")

    labels, tested, named = spark.createDataFrame([], "id long, label long"), [], []
    searched = members.filter(F.col("size") > PARTNERS + 1).select("key", "id")
    while True:
        named.append(written(_within_large(searched, known, labels, len(named), similarity), "near-named"))
        pairs = named[-1].filter("a <> b").select("a", "b")
        if not tested:
            pairs = pairs.unionByName(_within_small(members, known))
        pairs = pairs.distinct()
        if tested:
            pairs = pairs.join(reduce(DataFrame.unionByName, tested), ["a", "b"], "left_anti")
        tested.append(written(pairs, "near-pairs"))
        links = written(_verified(tested[-1], sets, similarity), "near-links")
        if links.limit(1).count():
            of = lambda side: labels.select(F.col("id").alias(side), F.col("label").alias(f"label_{side}"))
            between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
                F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).distinct()
            reached = propagate(between, "near")
            merged = reached.select(F.col("id").alias("label"), F.col("label").alias("merged"))
            labelled = labels.unionByName(links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
                                          .join(labels, "id", "left_anti").withColumn("label", F.col("id")))
            before, labels = labels, written(labelled.join(merged, "label", "left").select("id", F.coalesce("merged", "label").alias("label")),
                                             "near-labels")
            discard(before, reached)
        discard(links, *named[:-1])
        searched = named[-1].filter("a = b").select("key", F.col("a").alias("id")).distinct()
        if not searched.limit(1).count():
            break

    classes = reps.join(labels, "id", "left").select("id", "doc", "documents", F.coalesce("label", "id").alias("class"))
    facts = classes.groupBy("class").agg(F.min("doc").alias("class_doc"), F.sum("documents").alias("size"))
    classes = written(classes.select("id", "class").join(facts, "class").select("id", "class_doc", "size"), "near-classes")
    discard(reps, members, wanted, known, asked, sets, labels, *named, *tested)
    in_class = signed.select("doc", "id").join(classes, "id").select("doc", "class_doc", "size")
    alone = texts.filter(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(
        "doc", F.col("doc").alias("class_doc"), F.lit(1).cast("long").alias("size"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return in_class.unionByName(alone).select(
        back("doc").alias(id_col), back("class_doc").alias("class_id"), F.col("size").alias("class_size"),
        (F.col("doc") == F.col("class_doc")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document stays, with all their columns (which may have any name).

    Rows that repeat a kept id all stay; null ids, null, empty and very long texts, and
    empty tables are treated as in ``near_duplicates``.
    """
    docs, back = aside(docs, "__kept_id")
    kept = written(near_duplicates(docs, id_col, text_col, **options).filter("kept").select(F.col(id_col).alias("__kept_id")).distinct(), "near-kept")
    return back(docs.join(kept.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("__kept_id")), "left_semi"))
