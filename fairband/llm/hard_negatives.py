"""Hard negatives by exact inner-product search with a cover tree.

Vectors are augmented by one coordinate that gives all the same length, so an
inner product with an anchor depends on one angle only.  The top level of the tree
is made of pivots from a bounded sample; every row is indexed in the cell of its
nearest pivot, and cells are cut into blocks of bounded size.  In a block the tree
goes on: a node's children are rows far apart from each other, and each node knows
its covering radius, the largest angle from its centre to a row below it.  From
the angle between anchor and centre this bounds all inner products below a node.

A search is a window of scores, and how many of the best rows of some labels are
wanted from it.  Cells, nodes and leaves whose bounds lie outside the window, or below
the best rows found so far (first those of the sample), are skipped; the other leaves are opened best bound first
and compared exactly.  Skipping never loses a row, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairband.llm.common import python_workers, written

SAMPLE = 4096  # rows that pivots and first thresholds are taken from
CELL_ROWS = 2048  # rows a pivot, about, until there are MOST_CELLS
MOST_CELLS = 1024
BLOCK = 8192  # rows of a block, about
PAGE = 4096  # anchors that meet a block at once, about
CHUNK = 512  # anchors compared together
FANOUT, LEAF = 16, 64
LONGEST = float(1 << 53)  # squared length up to which sums of products are exact in doubles

NO_SCORE = -np.inf


def quantised(vectors: DataFrame, is_anchor: Column, id_col: str, label: Column, vector_col: str, scale: float) -> DataFrame:
    """``(id, key, label, vector, size, norm, anchor)`` with whole components ``floor(scale * x)``.

    ``key`` tells different rows of one id apart.
    """
    v = F.col("vector")
    part = lambda x: F.when(F.abs(x * scale) < float(1 << 52), F.floor(x * scale).cast("double")).otherwise(x * scale)
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                           F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
            .filter(F.col("id").isNotNull() & F.col("label").isNotNull()
                    & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
            .withColumn("vector", F.transform(v, part)))
    return (rows.withColumn("norm", F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)).filter(F.col("norm") <= LONGEST)
            .withColumns({"size": F.size(v), "key": F.xxhash64("label", "vector")}))


def augmented(rows: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors: each row with the coordinate that makes its squared length ``longest``."""
    rest = np.sqrt(np.maximum(longest - (rows * rows).sum(axis=1), 0.0))
    return np.hstack([rows, rest[:, None]]) / np.sqrt(longest)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def spread_out(units: np.ndarray, most: int, radius: float = 0.0) -> tuple[list[int], np.ndarray]:
    """Rows far from each other, the first row first, until all lie within ``radius`` of one or there are ``most``; and each row's nearest."""
    chosen, nearest, of = [0], _angles(units @ units[0]), np.zeros(len(units), np.int64)
    while len(chosen) < most and (far := int(nearest.argmax())) not in chosen and nearest[far] > radius:
        angle = _angles(units @ units[far])
        nearer = angle < nearest
        nearer[far] = True
        of[nearer] = len(chosen)
        nearest = np.where(nearer, angle, nearest)
        nearest[far] = 0.0
        chosen.append(far)
    return chosen, of


def cover_tree(units: np.ndarray, fanout: int = FANOUT, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows, and nodes level by level over ranges of that order.

    Nodes are rows of ``(start, end, parent, is leaf)``, parents before children; the row
    at ``start`` is a node's centre, and also the centre of its first child.
    The third array has each node's covering radius.  Children are at least half
    their parent's radius apart, or the ``fanout`` farthest ones.
    """
    order = np.arange(len(units))
    nodes, radii, at = [(0, len(units), -1)], [], 0
    leaves = []
    while at < len(nodes):
        start, end, _ = nodes[at]
        rows = order[start:end]
        radius = float(_angles(units[rows] @ units[rows[0]]).max()) + 1e-7  # rounding
        radii.append(radius)
        leaves.append(end - start <= leaf or radius < 1e-6)
        if not leaves[-1]:
            chosen, of = spread_out(units[rows], fanout, radius / 2)
            central = np.ones(len(rows), bool)
            central[chosen] = False
            sort = np.lexsort((central, of))
            order[start:end] = rows[sort]
            cuts = np.flatnonzero(np.diff(of[sort], prepend=-1)).tolist()
            nodes += [(start + a, start + b, at) for a, b in zip(cuts, [*cuts[1:], len(rows)])]
        at += 1
    return order, np.column_stack([np.array(nodes, np.int64), np.array(leaves, np.int64)]), np.array(radii)


def bounds(cosines: np.ndarray, radii: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and smallest inner product with rows within ``radii`` of centres at these cosines."""
    angle, slack = _angles(cosines), 1e-9 * reach[:, None] + 1e-6
    high = reach[:, None] * np.cos(np.maximum(angle - radii, 0.0)) + slack
    return high, reach[:, None] * np.cos(np.minimum(angle + radii, np.pi)) - slack


def best_of(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best entries of every query: larger scores first, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    sorted_queries = query[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_queries, sorted_queries) < k]


class Found:
    """The best ``k`` rows of every (query, window) so far, and the score that further rows must reach."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low.copy(), high, k
        self.held = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)) for _ in range(low.shape[1])]

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        for w, (q, s, i) in enumerate(self.held):
            take = (score >= self.low[query, w]) & (score <= self.high[query, w])
            if take.any():
                q, s, i = np.concatenate([q, query[take]]), np.concatenate([s, score[take]]), np.concatenate([i, ids[take]])
                best = best_of(q, s, i, self.k)
                self.held[w] = q, s, i = q[best], s[best], i[best]
                last = np.flatnonzero(np.bincount(q, minlength=len(self.low)) == self.k)
                if len(last):  # sorted by query, best first
                    ends = np.searchsorted(q, last, side="right") - 1
                    self.low[last, w] = np.maximum(self.low[last, w], s[ends])

    def wanted(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Which (query, node) bounds meet a window of the query above what it has found."""
        out = np.zeros(high.shape, bool)
        for w in range(self.low.shape[1]):
            out |= (high >= self.low[:, w, None]) & (low <= self.high[:, w, None]) & (self.low[:, w] <= self.high[:, w])[:, None]
        return out


class Block:
    """The rows of a block in tree order, with its tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, nodes: np.ndarray, radii: np.ndarray, longest: float):
        self.ids, self.labels, self.rows, self.nodes, self.radii, self.longest = ids, labels, rows.astype(float), nodes, radii, longest
        self.opened = 0

    def search(self, found: Found, queries: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool) -> None:
        """Offer ``found`` all rows of the label (``same``) or of other labels that can be among the best of its windows."""
        reach = np.sqrt((queries * queries).sum(axis=1) * self.longest)
        high, low = np.full((len(queries), len(self.nodes)), np.inf), np.full((len(queries), len(self.nodes)), -np.inf)
        alive = np.zeros(high.shape, bool)
        alive[:, 0] = True
        level, start, end, parent, leaf = np.array([0]), *self.nodes.T
        while len(level):  # down the tree: only nodes that some query still wants
            centres = queries @ self.rows[start[level]].T
            h, l = bounds(centres / np.maximum(reach, 1e-300)[:, None], self.radii[level], reach)
            up = parent[level]
            high[:, level] = np.where(up >= 0, np.minimum(h, high[:, up]), h)
            low[:, level] = np.where(up >= 0, np.maximum(l, low[:, up]), l)
            alive[:, level] = found.wanted(high[:, level], low[:, level]) & np.where(up >= 0, alive[:, up], True)
            level = np.flatnonzero(np.isin(parent, level[alive[:, level].any(axis=0) & (leaf[level] == 0)]))
        leaves = np.flatnonzero((leaf == 1) & alive.any(axis=0))
        high, low, alive = high[:, leaves], low[:, leaves], alive[:, leaves]
        order = np.argsort(np.where(alive, -high, np.inf), axis=1, kind="stable")
        opened, several = 0, 1
        while opened < len(leaves):  # the best leaf, the next two, the next four, ...
            now = np.zeros(alive.shape, bool)
            np.put_along_axis(now, order[:, opened:opened + several], True, axis=1)
            now &= alive & found.wanted(high, low)
            scores, rows, asking = [], [], []
            for n in np.flatnonzero(now.any(axis=0)).tolist():
                q, (a, b) = np.flatnonzero(now[:, n]), self.nodes[leaves[n], :2]
                score = queries[q] @ self.rows[a:b].T
                self.opened += score.size
                take = ((self.labels[a:b] == labels[q, None]) == same) & (self.ids[a:b] != ids[q, None])
                take &= (score >= found.low[q].min(axis=1)[:, None]) & (score <= found.high[q].max(axis=1)[:, None])
                i, j = np.nonzero(take)
                asking.append(q[i]), scores.append(score[i, j]), rows.append(a + j)
            if asking:
                found.offer(np.concatenate(asking), np.concatenate(scores), self.ids[np.concatenate(rows)])
            opened, several = opened + several, 2 * several


BLOCKS = "size int, cell int, part int, n int, ids binary, labels binary, rows binary, nodes binary, radii binary"


class Index:
    """A written table of blocks, and the bounded facts that a search starts from."""

    def __init__(self, valid: DataFrame, sample: int, cell_rows: int, most_cells: int, block: int):
        self.spark = valid.sparkSession
        facts = valid.agg(F.count("*").alias("n"), F.max("norm").alias("longest")).first()
        self.n, self.longest = facts["n"], max(facts["longest"] or 0.0, 1.0)
        few = valid.orderBy(F.xxhash64("id", F.lit("pivot")), "id", "key").limit(sample).select("size", "id", "label", "vector").collect()
        self.sample = {}
        for size in sorted({r["size"] for r in few}):
            of = [r for r in few if r["size"] == size]
            self.sample[size] = (np.array([r["id"] for r in of]), np.array([r["label"] for r in of]),
                                 np.array([r["vector"] for r in of], dtype=float).reshape(len(of), size))
        cells = max(1, min(most_cells, self.n // cell_rows))
        self.pivots = {size: (units := augmented(rows, self.longest))[spread_out(units, cells)[0]] for size, (_, _, rows) in self.sample.items()}
        placed = written(self._placed(valid), "negatives-cells")
        self.cells = {(r["size"], r["cell"]): (-(-r["n"] // block), r["radius"])
                      for r in placed.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect()}
        several = {f"{size}:{cell}": n for (size, cell), (n, _) in self.cells.items() if n > 1} | {"": 1}
        parts = F.create_map(*[F.lit(x) for item in several.items() for x in item])
        count = F.coalesce(F.try_element_at(parts, F.concat_ws(":", "size", "cell")), F.lit(1))
        self.blocks = written(self._built(placed.withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), count).cast("int"))), "negatives-blocks")

    def _placed(self, valid: DataFrame) -> DataFrame:
        pivots, longest = self.spark.sparkContext.broadcast(self.pivots), self.longest

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                cell, radius = np.zeros(len(batch), np.int32), np.full(len(batch), np.pi)
                sizes = batch["size"].to_numpy()
                for size in np.unique(sizes).tolist():
                    if size in pivots.value:
                        at = np.flatnonzero(sizes == size)
                        rows = np.array(batch["vector"].iloc[at].tolist(), dtype=float).reshape(len(at), size)
                        cosines = augmented(rows, longest) @ pivots.value[size].T
                        cell[at], radius[at] = cosines.argmax(axis=1), _angles(cosines.max(axis=1)) + 1e-7
                yield pd.DataFrame({"size": sizes, "cell": cell, "id": batch["id"], "label": batch["label"], "vector": batch["vector"], "radius": radius})

        return valid.select("size", "id", "label", "vector").mapInPandas(
            place, "size int, cell int, id long, label long, vector array<double>, radius double")

    def _built(self, placed: DataFrame) -> DataFrame:
        longest = self.longest

        def build(group: pd.DataFrame) -> pd.DataFrame:
            size = int(group["size"].iloc[0])
            ids, labels = group["id"].to_numpy(), group["label"].to_numpy()
            rows = np.array(group["vector"].tolist(), dtype=float).reshape(len(ids), size)
            first = np.argsort(ids)
            if len(np.unique(ids)) < len(ids):  # repeated rows count once
                first = np.unique(np.column_stack([ids, labels, rows.astype(np.int64)]), axis=0, return_index=True)[1]
            ids, labels, rows = ids[first], labels[first], rows[first]
            order, nodes, radii = cover_tree(augmented(rows, longest))
            return pd.DataFrame([(size, group["cell"].iloc[0], group["part"].iloc[0], len(order), ids[order].astype("<i8").tobytes(),
                                  labels[order].astype("<i8").tobytes(), rows[order].astype("<i4").tobytes(), nodes.astype("<i4").tobytes(),
                                  radii.astype("<f8").tobytes())], columns=[f.split()[0] for f in BLOCKS.split(", ")])

        return placed.drop("radius").groupBy("size", "cell", "part").applyInPandas(build, BLOCKS)

    def search(self, asked: DataFrame, same: bool, k: int, page: int) -> DataFrame:
        """The ``k`` best rows in every window of every row of ``asked`` ``(id, key, label, vector, size, low, high)``.

        ``low`` and ``high`` are arrays, a window each.  Returns ``(id, key, window, found, score)``.
        """
        pages = -(-asked.count() // page) or 1
        facts = self.spark.sparkContext.broadcast((self.sample, self.pivots, self.cells, self.longest))
        longest = self.longest
        to_page = F.pmod(F.xxhash64("id", F.lit("page")), F.lit(pages)).cast("int")

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sample, pivots, cells, _ = facts.value
            for batch in batches:
                for size, group in batch.groupby("size"):
                    queries = np.array(group["vector"].tolist(), dtype=float).reshape(len(group), size)
                    found = Found(np.array(group["low"].tolist()), np.array(group["high"].tolist()), k)
                    ids, labels = group["id"].to_numpy(), group["label"].to_numpy()
                    reach = np.sqrt((queries * queries).sum(axis=1) * longest)
                    if size in sample:  # rows of the sample are rows of the table: what they score, the best must reach
                        known, marks, rows = sample[size]
                        known, once = np.unique(known, return_index=True)
                        score = queries @ rows[once].T
                        i, j = np.nonzero(((marks[once] == labels[:, None]) == same) & (known != ids[:, None]))
                        found.offer(i, score[i, j], known[j])
                        high, low = bounds(queries @ pivots[size][:, :-1].T * np.sqrt(longest) / np.maximum(reach, 1e-300)[:, None],
                                           np.array([cells.get((size, c), (0, 0.0))[1] for c in range(len(pivots[size]))]), reach)
                        wanted = found.wanted(high, low)
                    else:
                        wanted = np.ones((len(group), 1), bool)
                    packed = [q.astype("<i4").tobytes() for q in queries]
                    for cell in range(wanted.shape[1]):
                        at = np.flatnonzero(wanted[:, cell])
                        for part in range(cells.get((size, cell), (0, 0))[0]):
                            if len(at):
                                yield pd.DataFrame({"size": size, "cell": cell, "part": part, "page": group["page"].to_numpy()[at], "id": ids[at],
                                                    "key": group["key"].to_numpy()[at], "label": labels[at], "vector": [packed[i] for i in at],
                                                    "low": list(found.low[at]), "high": list(found.high[at])})

        def compare(blocks: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(blocks) and len(asked):
                b = blocks.iloc[0]
                size, n = int(b["size"]), int(b["n"])
                block = Block(np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["labels"], "<i8"), np.frombuffer(b["rows"], "<i4").reshape(n, size),
                              np.frombuffer(b["nodes"], "<i4").reshape(-1, 4).astype(np.int64), np.frombuffer(b["radii"], "<f8"), longest)
                for at in range(0, len(asked), CHUNK):
                    part = asked.iloc[at:at + CHUNK]
                    queries = np.frombuffer(b"".join(part["vector"]), "<i4").reshape(len(part), size).astype(float)
                    found = Found(np.array(part["low"].tolist()), np.array(part["high"].tolist()), k)
                    ids, keys = part["id"].to_numpy(), part["key"].to_numpy()
                    block.search(found, queries, ids, part["label"].to_numpy(), same)
                    out += [pd.DataFrame({"id": ids[q], "key": keys[q], "window": w, "found": i, "score": s.astype(np.int64)})
                            for w, (q, s, i) in enumerate(found.held)]
            return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("id", "key", "window", "found", "score")})

        keys = ["size", "cell", "part", "page"]
        routed = asked.select("id", "key", "label", "vector", "size", "low", "high", to_page.alias("page")).mapInPandas(
            route, "size int, cell int, part int, page int, id long, key long, label long, vector binary, low array<double>, high array<double>")
        blocks = self.blocks.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
        each = blocks.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInPandas(compare, "id long, key long, window int, found long, score long")
        order = Window.partitionBy("id", "key", "window").orderBy(F.col("score").desc(), "found")
        return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, least_percent: int = 50,
         most_percent: int = 95, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE,
         cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS, block: int = BLOCK, page: int = PAGE) -> DataFrame:
    """Rows of other labels that score almost like an anchor's best rows of its own label.

    Vectors are rounded to ``floor(scale * x)``; a score is the exact integer inner
    product with the anchor.  An anchor's positives are its ``positives`` best other rows of
    its label.  For each positive the ``negatives`` best rows of other labels are returned
    that score from ``least_percent`` to ``most_percent`` of it: ``anchor_id``, ``positive_id``,
    ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``; higher scores first, ties to
    the smaller id, all if there are fewer, and no rows for negative positive scores.

    Rows with a null id, label or vector, or with a null or non-finite component,
    take no part, nor do those whose rounded vector has a squared length over
    2^53 (their products would not be exact).  Vectors of different sizes are not compared.  Rows that
    repeat id, label and vector count once; rows of an anchor's own id are neither
    its positives nor its negatives.  Empty tables give an empty result; other columns are not read.

    Bounds prune as far as the vectors allow: where all are about equally far
    apart, every block meets every page of anchors, and work grows with rows times anchors.
    """
    spark = vectors.sparkSession
    python_workers(spark)
    valid = written(quantised(vectors, is_anchor, id_col, label, vector_col, scale), "negatives-vectors")
    index = Index(valid, sample, cell_rows, most_cells, block)
    anchors = valid.filter("anchor").select("id", "key", "label", "vector", "size").dropDuplicates(["id", "key"])
    everything = {"low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf")))}
    best = index.search(anchors.withColumns(everything), True, positives, page)
    places = F.sequence(F.lit(1), F.lit(positives))
    hits = written(best.groupBy("id", "key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("scores"),
                                                 F.map_from_entries(F.collect_list(F.struct("rank", "found"))).alias("ids"))
                   .select("id", "key", F.transform(places, lambda r: F.try_element_at("scores", r)).alias("scores"),
                           F.transform(places, lambda r: F.try_element_at("ids", r)).alias("ids")), "negatives-positives")
    hundredth = lambda x: (x - x % 100) / 100
    fits = lambda s: s.isNotNull() & (s >= 0)
    windows = {"low": F.transform("scores", lambda s: F.when(fits(s), hundredth(s * least_percent + 99)).otherwise(1.0)),
               "high": F.transform("scores", lambda s: F.when(fits(s), hundredth(s * most_percent)).otherwise(0.0))}
    wrong = index.search(anchors.join(hits, ["id", "key"]).withColumns(windows), False, negatives, page)
    place = F.col("window") + 1
    return wrong.join(hits, ["id", "key"]).select(
        F.col("id").alias("anchor_id"), F.element_at("ids", place).alias("positive_id"), "rank", F.col("found").alias("negative_id"),
        F.element_at("scores", place).alias("positive_score"), F.col("score").alias("negative_score"))


QUERY_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.id % 50 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 3
"""
