"""Toxic passages: maximum-scoring segments over token log-odds.

Token log-odds come from document frequencies in labelled documents.  The rate of
a word is smoothed towards that of its prefix one character shorter, that one
towards its own prefix, and so on (a chain of Dirichlet priors), so inflected
forms share evidence.  A linear-time scan (Ruzzo and Tompa) finds all maximal
scoring segments of a text.  Their scores are calibrated by extreme-value
statistics (Karlin and Altschul): n tokens of harmless text hold K n exp(-lambda S)
segments of score S or more by chance.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairband.llm.common import discard, give_back, python_workers, written

WORD = regex.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 10  # prefix lengths
PRIOR = 3.0  # documents that the shorter prefix counts as
DRIFT = 0.7  # what every token costs, so that harmless text scores below zero
LEAST_DOCUMENTS = 3
BINS = np.arange(-12.0, 12.05, 0.1)
REMEMBERED = 150_000
DEFAULT = -DRIFT


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(word: str) -> list[str]:
    """The word with its end marked, after its prefixes, shortest first."""
    return [word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word + "$"]


@dataclass
class Model:
    odds: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0  # lambda
    rate: float = 1.0  # K
    slope: float = 1.0
    shift: float = 0.0

    def token_score(self, word: str) -> float:
        for f in reversed(features(word)):
            if (s := self.odds.get(f)) is not None:
                return s
        return DEFAULT

    def excess(self, score: float, n: int) -> float:
        """Minus the log of the number of such segments expected by chance among n tokens."""
        return self.scale * score - math.log(self.rate * max(n, 1))

    def evidence(self, segments: list[float], n: int) -> float:
        """Sum over the segments that are rarer than one by chance, or the best one's excess, bounded."""
        each = [self.excess(s, n) for s in segments]
        return min(60.0, max(-60.0, sum(x for x in each if x > 0) or max(each, default=self.excess(0.0, n))))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(700.0, max(-700.0, self.slope * evidence + self.shift))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` in linear time.

    Only positive tokens can start or end one, so the scan visits those; ``link``
    leads to the nearest earlier segment that starts at a lower running sum.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    left: list[float] = []
    right: list[float] = []
    span: list[tuple[int, int]] = []
    link: list[int] = []
    for i in np.flatnonzero(scores > 0).tolist():
        low, high, start, end = total[i], total[i + 1], i, i + 1
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = link[j]
            if j < 0 or right[j] >= high:
                break
            low, start = left[j], span[j][0]
            del left[j:], right[j:], span[j:], link[j:]
        left.append(low)
        right.append(high)
        span.append((start, end))
        link.append(j)
    return [(a, b, float(h - w)) for (a, b), w, h in zip(span, left, right)]


class Scorer:
    """Scores texts; remembers token scores, up to a fixed number of words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in set(tokens) if w not in known]
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                new = set(tokens)
            score = self.model.token_score
            known.update((w, score(w)) for w in new)
        return np.array([known[w] for w in tokens], dtype=np.float64)

    def segments(self, tokens: list[str], scores: np.ndarray) -> list[tuple[int, int, float]]:
        """The maximal segments of ``scores``; a word says less each time that one segment repeats it.

        Its k-th use in a segment counts 1/k^2; the segment scores what its best part then does.
        """
        out = []
        for a, b, score in maximal_segments(scores):
            seen: dict[str, int] = {}
            inside = scores[a:b].copy()
            for i in (np.flatnonzero(inside > 0).tolist() if b - a > 1 else ()):
                k = seen[tokens[a + i]] = seen.get(tokens[a + i], 0) + 1
                inside[i] /= k * k
            if max(seen.values(), default=1) > 1:
                score = max(s for _, _, s in maximal_segments(inside))
            out.append((a, b, score))
        return out


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int, id_col: str, text_col: str,
             label_col: str) -> DataFrame:
    """``(id, text, label)`` of at most ``per_class`` labelled documents of either label, by hash of the id."""
    one = (labels.filter(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("label")))
    lot = F.xxhash64("_id", F.lit("sample"))
    chosen = [one.filter(F.col("label") == k).orderBy(lot, "_id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 x per_class rows of two numbers
    return docs.select(id_col, text_col).join(sample, F.col(id_col) == F.col("_id")).select(
        F.col("_id").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), "label")


def document_frequencies(rows: DataFrame) -> DataFrame:
    """``(feature, toxic, clean)``: documents of either label that hold the feature."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = Counter(), Counter()
            for text, label in zip(batch["text"], batch["label"]):
                found[label].update({f for w in set(words(text)) for f in features(w)})
            names = list(found[0].keys() | found[1].keys())
            yield pd.DataFrame({"feature": names, "toxic": [found[1][f] for f in names], "clean": [found[0][f] for f in names]})

    return (rows.select("text", "label").mapInPandas(count, "feature string, toxic long, clean long")
            .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def scored_features(counted: DataFrame, toxic: int, clean: int) -> DataFrame:
    """``(feature, odds)`` of ``log_odds``, found where the features are.

    A feature's score depends on features that share its first letters only, so
    each task walks the chains of its own share of beginnings.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [row for batch in batches for row in zip(batch["feature"], batch["toxic"].tolist(), batch["clean"].tolist())]
        odds = log_odds(counts, toxic, clean)
        if odds:
            yield pd.DataFrame({"feature": list(odds.keys()), "odds": list(odds.values())})

    return counted.repartition(F.substring("feature", 1, SHORTEST)).mapInPandas(walk, "feature string, odds double")


def log_odds(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Score of every feature whose score, or whose prefix's score, is above zero."""
    base = (toxic + 0.5) / (toxic + clean + 1)
    start = math.log(base / (1 - base))
    rates: dict[str, float] = {}
    odds: dict[str, float] = {}
    for name, t, c in sorted(counts, key=lambda x: (len(x[0]) - x[0].endswith("$"), x[0].endswith("$"), x[0])):
        parent = name[:-1]
        while parent and parent not in rates:
            parent = parent[:-1]
        prior = rates.get(parent, base)
        rates[name] = min(0.999, max(0.001, (t + PRIOR * prior) / (t + c + PRIOR)))
        score = math.log(rates[name] / (1 - rates[name])) - start - DRIFT
        if score > 0 or odds.get(parent, DEFAULT) > 0:
            odds[name] = score
    return odds


def karlin_scale(values: np.ndarray, counts: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda s) = 1 (one imagined best token keeps it finite)."""
    counts = counts.astype(float)
    top = int(np.flatnonzero(values > 0)[-1]) if not counts[values > 0].any() else int(np.flatnonzero(counts)[-1])
    counts[top] += 1
    p = counts / counts.sum()
    if (p * values).sum() >= 0:
        return 0.1
    low, high = 0.0, 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * values, 500))).sum()) - 1
    while f(high) < 0 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(0.1, high)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-dimensional logistic fit, by Newton steps with a weak ridge."""
    a, b = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -500, 500)))
        g = np.array([((p - y) * x).sum() + 0.02 * a, (p - y).sum() + 0.002 * b])
        h = p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 0.02, (h * x).sum()], [(h * x).sum(), h.sum() + 0.002]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


def fit(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 10_000, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from at most ``per_class`` labelled documents of either label (rows where ``usable`` holds).

    Four fifths of them give the log-odds; lambda, K and the final logistic come
    from the other fifth, which the log-odds have not seen.  Labels other than 0 and 1, and
    null ids, are left out; of rows that repeat an id the larger label counts; null texts are empty;
    ties in the choice of rows go to the smaller id.  Without labels, or with one kind only, what cannot be learned
    keeps its default.
    """
    python_workers(docs.sparkSession)
    sample = written(labelled(docs, labels, usable, per_class, id_col, text_col, label_col)
                     .withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(5))), "toxic-sample")
    sizes = {(r["held"], r["label"]): r["n"] for r in sample.groupBy((F.col("part") == 0).alias("held"), "label")
             .agg(F.count("*").alias("n")).collect()}
    counted = (document_frequencies(sample.filter("part <> 0")).filter(F.col("toxic") + F.col("clean") >= LEAST_DOCUMENTS))
    kept = scored_features(counted, sizes.get((False, 1), 0), sizes.get((False, 0), 0)).toArrow()
    model = Model(dict(zip(kept["feature"].to_pylist(), kept["odds"].to_pylist())))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, histogram = Scorer(model), np.zeros(len(BINS) - 1, np.int64)
        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["label"]):
                tokens = words(text)
                scores = scorer.token_scores(tokens)
                out.append((label, len(scores), [s for _, _, s in scorer.segments(tokens, scores)], []))
                if not label:
                    histogram += np.histogram(np.clip(scores, BINS[0], BINS[-1] - 0.05), BINS)[0]
            yield pd.DataFrame(out, columns=["label", "n", "segments", "histogram"])
        yield pd.DataFrame([(-1, 0, [], histogram.tolist())], columns=["label", "n", "segments", "histogram"])

    measured = (sample.filter("part = 0").select("text", "label")
                .mapInPandas(measure, "label int, n int, segments array<double>, histogram array<long>").toArrow())
    discard(sample)
    rows = list(zip(*(measured[c].to_numpy() for c in ("label", "n", "segments", "histogram"))))
    held = [r for r in rows if r[0] >= 0]
    clean = [r for r in held if not r[0]]
    if clean:
        counts = np.sum([r[3] for r in rows if r[0] < 0], axis=0)
        model.scale = karlin_scale((BINS[:-1] + BINS[1:]) / 2, counts)
        # n K exp(-lambda S) of the best segment is exponential with mean 1
        chance = [n * math.exp(-model.scale * max(s, default=0.0)) for _, n, s, _ in clean if n]
        model.rate = max(1e-6, len(chance) / max(1e-9, sum(chance))) if chance else 1.0
    if clean and len(clean) < len(held):
        x = np.array([model.evidence(s, n) for _, n, s, _ in held])
        y = np.array([float(label) for label, *_ in held])
        model.slope, model.shift = logistic(x, y)
    return model


def _scorer(docs: DataFrame, model: Model, text: Column, significance: float) -> Column:
    python_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    most = -math.log(significance)

    @F.pandas_udf("score double, passages array<struct<first:int,after:int,score:double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        give_back()
        model = shared.value
        scorer = Scorer(model)
        for texts in batches:
            out = []
            for text in texts:
                tokens = words(text)
                found = scorer.segments(tokens, scorer.token_scores(tokens))
                evidence = model.evidence([s for _, _, s in found], len(tokens))
                out.append((model.probability(evidence), [{"first": a, "after": b, "score": s} for a, b, s in found
                                                          if model.excess(s, len(tokens)) > most]))
            yield pd.DataFrame(out, columns=["score", "passages"])

    return scored(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          significance: float = 0.05) -> DataFrame:
    """Score every whole text: ``id_col``, ``score`` (0 to 1) and ``passages``.

    ``passages`` are the maximal segments expected less than ``significance`` times
    by chance, as structs of first token, token after the last, and score.  Null
    and empty texts have no tokens and get the score of no evidence.  Other columns
    are not read; repeated rows are scored alike; an empty table stays empty.
    """
    return (docs.select(F.col(id_col).alias("_id"), _scorer(docs, model, F.col(text_col), significance).alias("_scored"))
            .select(F.col("_id").alias(id_col), "_scored.score", "_scored.passages"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns (of any name); nothing is shuffled.

    Null and empty texts have no tokens and get the score of no evidence; whole texts are scored,
    however long; rows with null or repeated ids are scored each for itself; an empty table stays empty.
    """
    return docs.filter(_scorer(docs, model, F.col(text_col), 0.05)["score"] < limit)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id's decimal text, modulo ``by``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by
