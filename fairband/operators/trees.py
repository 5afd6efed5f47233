"""Many small regression trees at once, on binned features of a bounded sample.

Model search fits thousands of trees on the same rows.  ``grow`` adds a level to
all trees of a batch with one histogram pass, whether the batch is the trees of a
forest or the next trees of many boosted models.  Rows of weight zero are carried
along: they never influence a split but get a prediction, so held-out folds are
scored while the trees grow and every prefix of a model costs nothing extra.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

VERSION = 3  # of what is grown: kept results of other versions are not read
BINS = 64
CELLS = 1 << 22  # histogram cells held at once
TOGETHER = 16_384  # rows whose histograms are made together
MODELS = 3  # boosted models whose next trees are grown together


@dataclass
class Binned:
    """Features as bin numbers, with the edges that cut raw values into them (a value equal to an edge lies below it)."""
    codes: np.ndarray  # rows x features, uint8
    edges: list[np.ndarray]


def quantile_edges(values: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per feature at most ``bins - 1`` edges, halfway between neighbouring values."""
    out = []
    for column in values.T:
        distinct = np.unique(column)
        middles = (distinct[:-1] + distinct[1:]) / 2
        if len(middles) >= bins:
            ranks = np.linspace(0, 1, bins + 1)[1:-1]
            at = np.unique(np.searchsorted(distinct, np.quantile(column, ranks, method="lower")))
            middles = middles[at[at < len(middles)]]
        out.append(middles)
    return out


def binned(values: np.ndarray, edges: list[np.ndarray]) -> Binned:
    codes = np.column_stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, values.T)])
    return Binned(codes.astype(np.uint8), edges)


@dataclass
class Level:
    """Nodes that one step made: the split of each (feature -1: a leaf) and where its children start on the next level."""
    feature: np.ndarray
    code: np.ndarray
    child: np.ndarray
    value: np.ndarray
    tree: np.ndarray
    gain: np.ndarray


@dataclass
class Trees:
    """Levels of a batch; tree ``t`` starts at node ``t`` of the first level."""
    levels: list[Level] = field(default_factory=list)

    def predict(self, codes: np.ndarray, count: int) -> np.ndarray:
        """Value of every (tree, row)."""
        rows = np.tile(np.arange(len(codes)), count)
        node = np.repeat(np.arange(count), len(codes))
        value, at = np.empty(len(rows)), np.arange(len(rows))
        for level in self.levels:
            value[at] = level.value[node]
            inner = level.feature[node] >= 0
            at, node = at[inner], node[inner]
            node = level.child[node] + (codes[rows[at], level.feature[node]] > level.code[node])
        return value.reshape(count, -1)

    def steps(self, codes: np.ndarray, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row, summed over the trees: the root values, and for every feature what its splits on the way down changed."""
        n = len(codes)
        rows, node = np.tile(np.arange(n), count), np.repeat(np.arange(count), n)
        start, changes = np.full(n, self.levels[0].value.sum()), np.zeros(n * width)
        for level, below in zip(self.levels, self.levels[1:]):
            inner = level.feature[node] >= 0
            rows, node = rows[inner], node[inner]
            feature = level.feature[node].astype(np.int64)
            to = level.child[node] + (codes[rows, feature] > level.code[node])
            changes += np.bincount(rows * width + feature, below.value[to] - level.value[node], n * width)
            node = to
        return start, changes.reshape(n, width)

    def gains(self, count: int, width: int) -> np.ndarray:
        """Per tree and feature: by how much its splits improved the objective."""
        out = np.zeros(count * width)
        for level in self.levels:
            inner = level.feature >= 0
            out += np.bincount(level.tree[inner] * width + level.feature[inner], level.gain[inner], count * width)
        return out.reshape(count, width)


def _soft(gradient: np.ndarray, alpha) -> np.ndarray:
    return np.sign(gradient) * np.maximum(np.abs(gradient) - alpha, 0.0)


class Passes:
    """How the features ``used`` are counted: few passes over the rows, and the candidate splits told apart by adding up.

    Features with few codes share one joint code (a pack); two packs are counted in one
    pass wherever nodes hold enough rows.  Features of equal codes (one a monotone function of
    the other) are counted once: every split of the later one ties with one of the first, which
    wins, so the later one matters only to trees that may not use the first (``apart``).
    ``left`` adds the bins left of every candidate split.
    """

    def __init__(self, by_feature: np.ndarray, sizes: list[int], first: list[int], used: np.ndarray, bins: int, apart: bool):
        self.bins = bins
        alike: dict[int, list[int]] = {}
        for place, feature in enumerate(used.tolist()):
            alike.setdefault(first[feature], []).append(place)
        packs: list[list[int]] = []
        for place in sorted((places[0] for places in alike.values()), key=lambda i: -sizes[used[i]]):
            for pack in packs:
                if math.prod(sizes[used[i]] for i in pack) * sizes[used[place]] <= bins:
                    pack.append(place)
                    break
            else:
                packs.append([place])
        self.single = []
        sums, candidates = np.zeros((len(packs), bins, bins)), []
        for p, pack in enumerate(packs):
            joint, at = by_feature[used[pack[0]]].astype(np.int64), 0
            for place in pack[1:]:
                joint *= sizes[used[place]]
                joint += by_feature[used[place]]
            self.single.append(joint)
            rest, cells = math.prod(sizes[used[i]] for i in pack), np.arange(bins)
            for place in pack:
                size = sizes[used[place]]
                rest //= size
                own = cells // rest % size
                for c in range(size - 1):
                    sums[p, own <= c, at] = 1.0
                    for one in alike[first[used[place]]] if apart else [place]:
                        candidates.append((one, c, p * bins + at))
                    at += 1
        candidates.sort()
        self.sums = sums
        self.feature = used[[c[0] for c in candidates]] if candidates else np.empty(0, np.int64)
        self.code = np.array([c[1] for c in candidates], np.int64)
        self.column = np.array([c[2] for c in candidates], np.int64)
        self.packs = len(packs)
        self.paired: list[np.ndarray] | None = None

    def pairs(self) -> list[np.ndarray]:
        if self.paired is None:
            self.paired = [a * self.bins + b for a, b in zip(self.single[::2], self.single[1::2])]
        return self.paired

    def histogram(self, keys: int, cells: np.ndarray, rows: np.ndarray, w: np.ndarray | None, t: np.ndarray,
                  counted: np.ndarray | None = None) -> np.ndarray:
        """Sums of weight and target by (pack, key, joint code); the weights are ``counted`` where they are known."""
        bins, out = self.bins, np.empty((2, self.packs, keys, self.bins))
        from_ = 0 if counted is None else 1
        if counted is not None:
            out[0] = counted
        alone = range(self.packs)
        if self.packs > 1 and keys * bins * bins <= 2 * len(rows):
            pairs = self.pairs()
            both = np.empty((2 - from_, len(pairs), keys, bins, bins))
            wide = cells * (bins * bins)
            for p, joint in enumerate(pairs):
                cell = joint.take(rows, mode="clip")
                cell += wide
                if counted is None:
                    both[0, p] = np.bincount(cell, w, keys * bins * bins).reshape(keys, bins, bins)
                both[-1, p] = np.bincount(cell, t, keys * bins * bins).reshape(keys, bins, bins)
            out[from_:, :2 * len(pairs):2] = (both.reshape(-1, bins) @ np.ones(bins)).reshape(-1, len(pairs), keys, bins)
            out[from_:, 1:2 * len(pairs):2] = both.sum(axis=3)
            alone = range(2 * len(pairs), self.packs)
        if alone:
            wide = cells * bins
            for p in alone:
                cell = self.single[p].take(rows, mode="clip")
                cell += wide
                if counted is None:
                    out[0, p] = np.bincount(cell, w, keys * bins).reshape(keys, bins)
                out[1, p] = np.bincount(cell, t, keys * bins).reshape(keys, bins)
        return out

    def left(self, both: np.ndarray) -> np.ndarray:
        """Sums of weight and target left of every candidate: (2, key, candidate), by feature and code."""
        _, packs, keys, bins = both.shape
        return np.matmul(both, self.sums).transpose(0, 2, 1, 3).reshape(2, keys, packs * bins).take(self.column, axis=2)


class Features:
    """Codes of the rows, feature by feature, and how sets of them are counted."""

    def __init__(self, codes: np.ndarray, bins: int):
        self.by_feature, self.bins = np.ascontiguousarray(codes.T), bins
        self.flat = self.by_feature.ravel()
        self.sizes = (self.by_feature.max(axis=1).astype(int) + 1).tolist() if codes.size else [1] * codes.shape[1]
        seen: dict[bytes, int] = {}
        self.first = [seen.setdefault(column.tobytes(), i) for i, column in enumerate(self.by_feature)]  # of equal columns
        self.kept: tuple[tuple, Passes] | None = None

    def passes(self, used: np.ndarray, apart: bool) -> Passes:
        if self.kept is None or self.kept[0] != (used.tobytes(), apart):
            self.kept = (used.tobytes(), apart), Passes(self.by_feature, self.sizes, self.first, used, self.bins, apart)
        return self.kept[1]


def grow(codes: np.ndarray | Features, bins: int, target: np.ndarray, weight: np.ndarray, depth: int, least: np.ndarray,
         l2: np.ndarray, l1: np.ndarray, allowed: np.ndarray | None = None, keep: bool = False,
         at_depths: tuple[int, ...] = ()) -> tuple[np.ndarray, Trees, dict[int, np.ndarray]]:
    """Grow one tree for every row of ``target`` (trees x rows), level by level.

    A leaf's value is the shrunken weighted mean of ``target``: sums are pulled
    towards zero by ``l1`` and divided by weight plus ``l2``; a split must improve the matching
    objective and leave ``least`` weight on both sides.  ``allowed`` masks features
    per tree.  Returns every row's value, the trees if ``keep``, and the values
    the rows would have if the trees stopped at each of ``at_depths``.
    """
    features = codes if isinstance(codes, Features) else Features(codes, bins)
    count, n = target.shape
    width, flat_codes = len(features.by_feature), features.flat
    used = np.arange(width) if allowed is None else np.flatnonzero(allowed.any(axis=0))  # features that some tree may split on
    apart = allowed is not None and not allowed[:, used].all()
    passes = features.passes(used, apart)
    allowed = allowed[:, passes.feature] if apart else None
    shrunk = bool(l1.any())
    value, stopped, trees = np.zeros(count * n), {}, Trees()
    of = np.arange(count)
    # rows that are learned from, tree after tree, and the others, which only walk along
    heavy = [np.flatnonzero(x > 0) for x in weight]
    idle = [np.flatnonzero(x <= 0) for x in weight]
    row, idle_row = np.concatenate(heavy), np.concatenate(idle)
    slot, idle_slot = (np.repeat(of, [len(x) for x in rows]) for rows in (heavy, idle))
    t = np.concatenate([x[rows] for x, rows in zip(target, heavy)])
    w = np.concatenate([x[rows] for x, rows in zip(weight, heavy)]).astype(float)
    if (w == 1).all():
        w = None
    else:
        t = t * w

    def best_splits(both: np.ndarray, own: np.ndarray, sum_w: np.ndarray, sum_t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(passes.column):
            return np.zeros(len(own), np.int64), np.full(len(own), -np.inf)
        left_w, left_t = passes.left(both)
        right_w, right_t = sum_w[:, None] - left_w, sum_t[:, None] - left_t
        a, b = l1[own][:, None], l2[own][:, None]
        bad = np.minimum(left_w, right_w) < least[own][:, None] - 1e-9
        for part_w, part_t in ((left_w, left_t), (right_w, right_t)):
            if shrunk:
                np.abs(part_t, out=part_t)
                part_t -= a
                np.maximum(part_t, 0.0, out=part_t)
            part_w += b
            part_t *= part_t
            with np.errstate(divide="ignore", invalid="ignore"):
                part_t /= part_w
        gain = left_t
        gain += right_t
        gain[bad] = -np.inf
        if allowed is not None:
            gain[~allowed[own]] = -np.inf
        top = gain.max(axis=1)
        slack = np.where(np.isfinite(top), 1e-9 * (1 + np.abs(top)), 0.0)
        best = (gain >= (top - slack)[:, None]).argmax(axis=1)  # the first of equal ones, whatever the rounding
        return best, gain[np.arange(len(own)), best]

    most = max(1, CELLS // (passes.packs * bins)) if passes.packs else 1  # nodes whose histograms are held at once
    above = None  # histograms of the parents of this level's pairs of nodes
    for level in range(depth + 1):
        nodes = len(of)
        rows_in = np.bincount(slot, minlength=nodes)
        sum_w, sum_t = rows_in.astype(float) if w is None else np.bincount(slot, w, nodes), np.bincount(slot, t, nodes)
        node_value = np.divide(_soft(sum_t, l1[of]), sum_w + l2[of], out=np.zeros(nodes), where=sum_w + l2[of] > 0)
        if level in at_depths:
            stopped[level] = value.copy()
            for s, r in ((slot, row), (idle_slot, idle_row)):
                stopped[level][of[s] * n + r] = node_value[s]
            stopped[level] = stopped[level].reshape(count, n)
        feature, code, gain, both = np.full(nodes, -1), np.zeros(nodes, np.int64), np.zeros(nodes), None
        if level < depth and nodes:
            best = np.zeros(nodes, np.int64)
            if nodes <= most:
                both = np.empty((2, passes.packs, nodes, bins))
                # nodes and rows are in the order of their trees: few trees at a time, so that they stay in the processor's cache
                first = np.append(np.flatnonzero(np.diff(of, prepend=-1)), nodes)
                first_row = np.concatenate([[0], np.cumsum(rows_in)])[first]
                start, last = 0, None  # last: rows and counts of the tree before, at the roots
                while start < len(first) - 1:
                    stop = start + 1
                    while stop < len(first) - 1 and first_row[stop + 1] - first_row[start] <= TOGETHER:
                        stop += 1
                    part, mine = slice(first[start], first[stop]), slice(first_row[start], first_row[stop])
                    own, keys = slot[mine] - part.start, part.stop - part.start
                    if above is None:
                        known = last[1] if w is None and keys == 1 and last is not None and np.array_equal(last[0], row[mine]) else None
                        both[:, :, part] = passes.histogram(keys, own, row[mine], None if w is None else w[mine], t[mine], known)
                        last = (row[mine], both[0, :, part]) if keys == 1 else None
                    else:  # count the lighter of two siblings, the other is the rest of their parent
                        pair = 2 * np.arange(keys // 2)
                        right = (sum_w[part][1::2] < sum_w[part][::2]).astype(np.int64)
                        lighter = np.zeros(keys, bool)
                        lighter[pair + right] = True
                        few = np.flatnonzero(lighter.take(own, mode="clip"))
                        pairs = own.take(few) >> 1
                        few += mine.start
                        one = passes.histogram(keys // 2, pairs, row.take(few), None if w is None else w.take(few), t.take(few))
                        both[:, :, part.start + pair + right] = one
                        both[:, :, part.start + pair + 1 - right] = above[:, :, part.start // 2:part.stop // 2] - one
                    best[part], gain[part] = best_splits(both[:, :, part], of[part], sum_w[part], sum_t[part])
                    start = stop
            else:  # many small nodes: some at a time
                order = np.argsort(slot, kind="stable")
                cuts = np.searchsorted(slot[order], np.arange(0, nodes + most, most))
                for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    some, part = order[i:j], slice(k * most, min(nodes, (k + 1) * most))
                    each = passes.histogram(len(of[part]), slot[some] - k * most, row[some], None if w is None else w[some], t[some])
                    best[part], gain[part] = best_splits(each, of[part], sum_w[part], sum_t[part])
            parent = np.divide(_soft(sum_t, l1[of]) ** 2, sum_w + l2[of], out=np.zeros(nodes), where=sum_w + l2[of] > 0)
            gain = gain - parent
            split = gain > 1e-10 * (1 + np.abs(parent))
            if split.any():
                feature = np.where(split, passes.feature[best], -1)
                code = passes.code[best]
        inner = np.flatnonzero(feature >= 0)
        child = np.zeros(nodes, np.int64)
        child[inner] = 2 * np.arange(len(inner))
        if keep:
            trees.levels.append(Level(feature.astype(np.int16), code.astype(np.int16), child.astype(np.int32), node_value, of,
                                      np.where(feature >= 0, gain, 0.0).astype(np.float32)))
        base, column = of * n, feature.astype(np.int64) * n

        def step(slot: np.ndarray, row: np.ndarray) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
            """Nodes and rows that go on, and which these are (None: all); the others get their values."""
            going = None
            if len(inner) < nodes:
                on = (feature >= 0).take(slot, mode="clip") if len(inner) else np.zeros(len(slot), bool)
                end = np.flatnonzero(~on) if len(inner) else slice(None)
                ends = slot[end]
                value[base.take(ends, mode="clip") + row[end]] = node_value.take(ends, mode="clip")
                going = np.flatnonzero(on)
                slot, row = slot.take(going), row.take(going)
            if not len(slot):
                return going, slot, row
            at = column.take(slot, mode="clip")
            at += row
            below = child.take(slot, mode="clip")
            below += flat_codes.take(at, mode="clip") > code.take(slot, mode="clip")
            return going, below, row

        going, slot, row = step(slot, row)
        if going is not None:
            w, t = None if w is None else w.take(going), t.take(going)
        _, idle_slot, idle_row = step(idle_slot, idle_row)
        if not len(slot) and not len(idle_slot):
            for d in at_depths:
                if d not in stopped:
                    stopped[d] = value.reshape(count, n).copy()
            break
        above = None if both is None or 2 * len(inner) > most else both[:, :, inner]
        of = np.repeat(of[inner], 2)
    return value.reshape(count, n), trees, stopped


def forest(codes: np.ndarray, bins: int, target: np.ndarray, weight: np.ndarray, trees: int, depth: int, least: float, seed: int,
           prefixes: tuple[int, ...] = (), depths: tuple[int, ...] = (), batch: int = 25, keep: bool = False, first: int = 0):
    """Bagged trees: predictions ``{(depth, trees): mean}`` at every prefix and depth, and the trees if ``keep``.

    A tree stopped at a smaller depth is the tree of that depth, and the first trees of
    a forest are a forest, so one fit answers for all of them.  Every tree draws
    as many rows as have weight, with replacement; ``first`` is the number of the first
    tree, for tasks that grow a part of a forest.
    """
    depths, prefixes = depths or (depth,), prefixes or (trees,)
    heavy = np.flatnonzero(weight > 0)
    sums, out, kept, done = {d: np.zeros(len(target)) for d in depths}, {}, [], 0
    features = Features(codes, bins)
    cuts = sorted({*prefixes, *range(batch, trees, batch), trees})
    for stop in cuts:
        count = stop - done
        drawn = np.zeros((count, len(target)))
        for i in range(count):
            pick = np.random.default_rng([seed, first + done + i]).integers(0, len(heavy), len(heavy))
            drawn[i, heavy] = np.bincount(pick, minlength=len(heavy))
        none = np.zeros(count)
        value, grown, stopped = grow(features, bins, np.broadcast_to(target, drawn.shape), drawn, depth, np.full(count, least), none, none,
                                     keep=keep, at_depths=tuple(depths))
        for d in depths:
            sums[d] += stopped.get(d, value).sum(axis=0)
        if keep:
            kept.append((count, grown))
        done = stop
        if stop in prefixes:
            out |= {(d, stop): sums[d] / stop for d in depths}
    return (out, kept) if keep else out


@dataclass(frozen=True)
class Boost:
    """One boosted model of a batch; the number of rounds belongs to the batch."""
    depth: int = 5
    rate: float = 0.1
    rows: float = 1.0
    columns: float = 1.0
    least: float = 1.0
    l1: float = 0.0
    l2: float = 0.0


def boosted(codes: np.ndarray, bins: int, target: np.ndarray, weight: np.ndarray, models: list[Boost], rounds: int, seed: int,
            stages: tuple[int, ...] = (), keep: bool = False):
    """Boosted least-squares trees for ``models`` of equal depth: ``{rounds: predictions (models x rows)}`` at every stage.

    A model of 1,000 rounds passes through those of 500 and 800, so one fit scores
    all of them; rows and columns are sampled by round, not by the final number of rounds.
    """
    stages = stages or (rounds,)
    heavy = np.flatnonzero(weight > 0)
    start = float((target * weight).sum() / weight.sum())
    score = np.full((len(models), len(target)), start)
    get = lambda name: np.array([getattr(m, name) for m in models], float)
    rate, least, l1, l2 = get("rate"), get("least"), get("l1"), get("l2")
    width, out, kept = codes.shape[1], {}, []
    sampled, masked = any(m.rows < 1 for m in models), any(m.columns < 1 for m in models)
    full = np.broadcast_to(weight.astype(float), score.shape)
    features, together = Features(codes, bins), len(models) if keep else MODELS
    for r in range(1, rounds + 1):
        rng = np.random.default_rng([seed, r])
        w, allowed = full, None
        if sampled:
            order = rng.permutation(len(heavy))
            w = full.copy()
            for i, m in enumerate(models):
                w[i, heavy[order[max(1, int(m.rows * len(heavy))):]]] = 0.0
        if masked:
            order = rng.permutation(width)
            allowed = np.zeros((len(models), width), bool)
            for i, m in enumerate(models):
                allowed[i, order[:max(1, int(m.columns * width))]] = True
        for i in range(0, len(models), together):
            m = slice(i, i + together)
            value, grown, _ = grow(features, bins, target - score[m], w[m], models[0].depth, least[m], l2[m], l1[m],
                                   None if allowed is None else allowed[m], keep)
            score[m] += rate[m, None] * value
            if keep:
                kept.append((len(models), grown))
        if r in stages:
            out[r] = score.copy()
    return (out, start, kept) if keep else out
