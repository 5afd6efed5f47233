"""Text quality by histogram gradient-boosted trees over document statistics.

Spark ML grows the boosted trees (its learner works on binned histograms that are
summed over partitions) from a bounded sample of labelled documents.  The fitted
trees are flattened into arrays, and a block of documents walks all trees at once
in numpy, next to where its statistics were computed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairband.llm.common import discard, python_workers, written
from fairband.session import scratch_path

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "spaces", "line_ends", "sentence_marks",
            "symbols", "wide", "bars", "distinct_words", "top_word", "distinct_lines", "repeated_next", "symbol_words",
            "distinct_tail", "longest_word")
_CLASSES = np.zeros(256, np.int64)
for _name, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:?'\"-()",
                                b"!#$%&*+/<=>@[\\]^_`{}~", bytes(range(128, 256)), b"|"), start=1):
    _CLASSES[list(_chars)] = _name
_SYMBOL_END = re.compile(r"[!#$%&*+/<=>@^_`{}~|]{2}(?=\s|$)")


def statistics(text: str) -> list[float]:
    """One number per name in ``FEATURES``, over the whole text; all shares are 0 for an empty text."""
    raw = text.encode("utf-8", "replace")
    tokens = text.split()
    n, w = max(len(raw), 1), max(len(tokens), 1)
    share = np.bincount(_CLASSES[np.frombuffer(raw, np.uint8)], minlength=9) / n
    counts = Counter(tokens)
    lines = [x for x in text.split("\n") if x.strip()]
    half = tokens[len(tokens) // 2:]
    return [np.log1p(len(raw)), np.log1p(len(tokens)), len(raw) / w, *share[1:7].tolist(), share[7], share[8],
            len(counts) / w, max(counts.values(), default=0) / w, len(set(lines)) / max(len(lines), 1),
            sum(map(str.__eq__, tokens, tokens[1:])) / w, len(_SYMBOL_END.findall(text)) / w,
            len(set(half) - set(tokens[:len(tokens) // 2])) / max(len(half), 1), min(max(map(len, tokens), default=0), 200)]


@dataclass
class Forest:
    """Boosted trees as parallel arrays; node 0 of each tree is its entry in ``roots``."""

    roots: np.ndarray
    feature: np.ndarray  # -1 at leaves
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # of leaves, times the tree's weight
    depth: int

    def margin(self, rows: np.ndarray) -> np.ndarray:
        """Sum of the leaves that every row reaches, all trees in step."""
        node = np.repeat(self.roots[None, :], len(rows), axis=0)
        at = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            step = np.where(rows[at, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
            node = np.where(f < 0, node, step)
        return self.value[node].sum(axis=1)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * self.margin(rows)))  # the learner's logistic loss has margins of half the log-odds


def flatten(model, nodes: DataFrame) -> Forest:
    """Arrays from the saved node table, whose size is trees x 2^depth."""
    rows = nodes.select("treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("prediction"),
                        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
                        F.col("nodeData.split.featureIndex").alias("feature"),
                        F.col("nodeData.split.leftCategoriesOrThreshold").alias("cut")).orderBy("treeID", "id").collect()
    place = {(r["treeID"], r["id"]): k for k, r in enumerate(rows)}
    leaf = np.array([r["left"] < 0 for r in rows])
    child = lambda side: np.array([place.get((r["treeID"], r[side]), 0) for r in rows])
    return Forest(
        roots=np.array([place[t, 0] for t in sorted({r["treeID"] for r in rows})]),
        feature=np.where(leaf, -1, [r["feature"] for r in rows]),
        threshold=np.array([0.0 if end else r["cut"][0] for end, r in zip(leaf, rows)]),
        left=child("left"), right=child("right"),
        value=np.array([r["prediction"] * model.treeWeights[r["treeID"]] for r in rows]),
        depth=max(t.depth for t in model.trees))


def constant(probability: float) -> Forest:
    one = np.zeros(1, np.int64)
    return Forest(one, one - 1, np.zeros(1), one, one, np.array([np.log(probability / (1 - probability)) / 2]), 0)


def _described(docs: DataFrame, text: Column, *others: Column) -> DataFrame:
    @F.pandas_udf("array<double>")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts])

    return docs.select(*others, described(F.coalesce(text, F.lit(""))).alias("statistics"))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, most_rows: int = 20_000, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality", trees: int = 30, depth: int = 4, seed: int = 7) -> Forest:
    """Learn from at most ``most_rows`` labelled documents (those where ``usable`` holds, by hash of the id).

    Labels other than 0 and 1 and null ids are left out.  Without labels, or with
    labels of one kind, every document gets the smoothed share of label 1.
    """
    spark = docs.sparkSession
    python_workers(spark)
    chosen = (labels.filter(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("label"))
              .orderBy(F.xxhash64("_id", F.lit("sample")), "_id").limit(most_rows))  # a bound on what is broadcast
    sample = written(_described(docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("_id")), F.col(text_col),
                                F.col("_id").alias("id"), F.col("label")), "quality-sample")
    seen = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        discard(sample)
        return constant((seen.get(1.0, 0) + 1) / (sum(seen.values()) + 2))
    # at most ``most_rows`` short rows, read again for every tree level: few tasks serve them best
    rows = sample.orderBy("id").coalesce(8).withColumn("features", array_to_vector("statistics"))
    model = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.2, minInstancesPerNode=3,
                          subsamplingRate=0.8, seed=seed).fit(rows)
    discard(sample)
    path = scratch_path(spark, f"models/{model.uid}")
    model.write().overwrite().save(path)
    return flatten(model, spark.read.parquet(f"{path}/data"))


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality of every whole text: ``id_col`` and ``score`` (0 to 1).

    Null and empty texts are scored by the statistics of an empty text.  Other
    columns are not read; repeated rows score alike; an empty table stays empty.
    """
    python_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pd.Series(shared.value.probability(rows))

    return docs.select(F.col(id_col), scored(F.coalesce(F.col(text_col), F.lit(""))).alias("_score")).withColumnsRenamed({"_score": "score"})
