"""Conditional-inference trees grown level by level.

A level is one aggregation job: the histogram of all open nodes, of a size that
depends on nodes, features and bins only.  The driver tests each feature by its
permutation p-value, takes the best split of the chosen one and routes rows with
a column expression over their bins.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citspark.functions.columns import OTHER_KEY

from .stats import chi2_sf, histogram


def number(x: float) -> str:
    """A double literal in any SQL: with an exponent."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


@dataclass(frozen=True)
class TreeParams:
    max_depth: int = 6
    alpha: float = 0.05
    lambda_l2: float = 1.0
    min_samples_split: int = 2
    min_data_in_leaf: float = 0.0
    min_child_weight: float = 0.0
    gamma: float = 0.0
    max_leaves: int = 0
    max_leaf_weight: float = 0.0
    grow_policy: str = "depthwise"
    monotone: tuple[int, ...] = ()
    interactions: tuple[tuple[int, ...], ...] = ()
    feature_weights: tuple[float, ...] = ()


@dataclass
class Node:
    depth: int
    weight: float = 0.0
    lo: float = float("-inf")
    hi: float = float("inf")
    groups: frozenset[int] | None = None
    feature: int = -1
    bin: int = -1
    left_bins: tuple[int, ...] = ()
    gain: float = 0.0
    left: int = -1
    right: int = -1

    @property
    def is_leaf(self) -> bool:
        return self.feature < 0


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)

    def goes_left(self, node: Node, bins: str) -> Column:
        b = F.get(F.col(bins), F.lit(node.feature))
        return b.isin(list(node.left_bins)) if node.left_bins else b <= node.bin

    def value(self, bins: str = "bins", what: str = "weight", at: int = 0) -> Column:
        """Leaf weight (or node index) as nested decisions over the bins."""
        node = self.nodes[at]
        if node.is_leaf:
            return F.lit(float(node.weight)) if what == "weight" else F.lit(at)
        return F.when(self.goes_left(node, bins), self.value(bins, what, node.left)).otherwise(self.value(bins, what, node.right))

    def importances(self, n: int) -> list[float]:
        out = [0.0] * n
        for node in self.nodes:
            if not node.is_leaf:
                out[node.feature] += node.gain
        return out

    def sql(self, bins: list, at: int = 0) -> str:
        """The tree as a CASE expression over raw columns, described by their FeatureBins."""
        node = self.nodes[at]
        if node.is_leaf:
            return number(node.weight)
        own = bins[node.feature]
        if own.categorical:
            keys = ", ".join("'" + own.keys[b].replace("'", "''") + "'" for b in node.left_bins)
            key = f"COALESCE(CAST({own.name} AS STRING), '__missing__')"
            if OTHER_KEY in own.keys and own.keys.index(OTHER_KEY) in node.left_bins:
                right = ", ".join("'" + k.replace("'", "''") + "'" for b, k in enumerate(own.keys) if b not in node.left_bins)
                test = f"{key} NOT IN ({right})"
            else:
                test = f"{key} IN ({keys})"
        else:
            test = f"CAST(CAST({own.name} AS FLOAT) AS DOUBLE) < {number(own.cuts[node.bin])}"
        return f"CASE WHEN {test} THEN {self.sql(bins, node.left)} ELSE {self.sql(bins, node.right)} END"


def _score(g: float, h: float, l2: float) -> float:
    return g * g / (h + l2) if h + l2 else 0.0


def _weight(g: float, h: float, l2: float, node: Node) -> float:
    w = -g / (h + l2) if h + l2 else 0.0
    return max(node.lo, min(node.hi, w))


def feature_test(bins: dict[int, tuple[float, ...]]) -> tuple[float, int, float]:
    """chi-square, degrees of freedom and p-value of one feature's histogram."""
    live = [(w, g, q) for w, g, _, q in bins.values() if w > 0]
    n = sum(x[0] for x in live)
    if n <= 1 or len(live) < 2:
        return 0.0, 0, 1.0
    mean = sum(x[1] for x in live) / n
    var = max(0.0, sum(x[2] for x in live) / n - mean * mean)
    if var <= 2.220446049250313e-16:
        return 0.0, len(live) - 1, 1.0
    chi = (n - 1) / (n * var) * sum((g - w * mean) ** 2 / w for w, g, _ in live)
    return chi, len(live) - 1, chi2_sf(chi, len(live) - 1)


def best_split(bins: dict[int, tuple[float, ...]], p: TreeParams, categorical: bool = False, monotone: int = 0, node: Node | None = None) -> tuple[float, int, tuple[int, ...]] | None:
    """Largest gain over prefixes of the bins (categories: by G / (H + lambda))."""
    node = node or Node(0)
    order = sorted(bins) if not categorical else sorted((b for b in bins if bins[b][0] > 0), key=lambda b: (bins[b][1] / (bins[b][2] + p.lambda_l2 or 1.0), b))
    tw, tg, th = (sum(bins[b][k] for b in bins) for k in range(3))
    whole, best = _score(tg, th, p.lambda_l2), None
    w = g = h = 0.0
    for k, b in enumerate(order[:-1]):
        w, g, h = w + bins[b][0], g + bins[b][1], h + bins[b][2]
        if min(w, tw - w) < p.min_data_in_leaf or min(w, tw - w) <= 0 or min(h, th - h) < p.min_child_weight:
            continue
        if monotone and monotone * (_weight(tg - g, th - h, p.lambda_l2, node) - _weight(g, h, p.lambda_l2, node)) < 0:
            continue
        value = _score(g, h, p.lambda_l2) + _score(tg - g, th - h, p.lambda_l2) - whole
        if value > max(p.gamma, 0.0) and (best is None or value > best[0]):
            best = (value, b, tuple(sorted(order[: k + 1])) if categorical else ())
    return best


def _allowed(f: int, node: Node, p: TreeParams) -> bool:
    if p.feature_weights and p.feature_weights[f] <= 0:
        return False
    groups = {k for k, g in enumerate(p.interactions) if f in g}
    return not groups or node.groups is None or bool(groups & node.groups)


def _groups_below(f: int, node: Node, p: TreeParams) -> frozenset[int] | None:
    """Interaction groups that hold all constrained features of the path; None: no bound."""
    own = frozenset(k for k, g in enumerate(p.interactions) if f in g)
    if not own:
        return node.groups
    return (own if node.groups is None else own & node.groups) or None


def grow(rows: DataFrame, p: TreeParams, features: list[int], categorical: frozenset[int] = frozenset(), bins: str = "bins", n: str | None = None) -> Tree:
    """One tree over rows with g, h, w and ``bins``; ``n`` is how many rows a row stands for."""
    tree = Tree([Node(0, lo=-p.max_leaf_weight if p.max_leaf_weight > 0 else float("-inf"), hi=p.max_leaf_weight if p.max_leaf_weight > 0 else float("inf"))])
    open_ = [0]
    ranked = bool(p.monotone or p.interactions or p.feature_weights)
    while open_:
        at = tree.value(bins, "index") if len(tree.nodes) > 1 else F.lit(0)
        hist: dict[int, dict[int, dict[int, tuple]]] = defaultdict(lambda: defaultdict(dict))
        count: dict[int, int] = defaultdict(int)
        placed = rows.withColumn("node", at)
        if len(tree.nodes) > 1:
            placed = placed.filter(F.col("node").isin(open_))
        kept = F.array(*(F.get(F.col(bins), F.lit(f)) for f in features))
        for r in histogram(placed.withColumn("__bins", kept), ["node"], "__bins", n=n).collect():
            hist[r.node][features[r.feature]][r.bin] = (r.sum_w, r.sum_g, r.sum_h, r.sum_gg)
            if r.feature == 0:
                count[r.node] += r.n
        following = []
        for i in open_:
            node, own = tree.nodes[i], hist[i]
            if not own:
                continue
            first = own[features[0]].values()
            g, h = sum(x[1] for x in first), sum(x[2] for x in first)
            node.weight = _weight(g, h, p.lambda_l2, node)
            if node.depth >= p.max_depth or count[i] < p.min_samples_split:
                continue
            tests = {f: feature_test(b) for f, b in own.items() if _allowed(f, node, p)}
            tests = {f: t for f, t in tests.items() if t[1] > 0}
            if not tests:
                continue
            mono = lambda f: p.monotone[f] if p.monotone and f not in categorical else 0
            if ranked:
                found = [(s[0] * (p.feature_weights[f] if p.feature_weights else 1.0), f, s) for f, t in tests.items() if t[2] <= p.alpha and (s := best_split(own[f], p, f in categorical, mono(f), node))]
                chosen = max(found, key=lambda x: (x[0], -x[1]), default=None)
            else:
                f = min(tests, key=lambda f: (tests[f][2], -tests[f][0], f))
                s = best_split(own[f], p, f in categorical) if tests[f][2] <= p.alpha else None
                chosen = (s[0], f, s) if s else None
            if chosen is None:
                continue
            _, f, (value, b, left_bins) = chosen
            node.feature, node.bin, node.left_bins, node.gain = f, b, left_bins, value
            below = _groups_below(f, node, p)
            left, right = (Node(node.depth + 1, lo=node.lo, hi=node.hi, groups=below) for _ in range(2))
            if mono(f):
                lg = sum(x[1] for k, x in own[f].items() if k <= b)
                lh = sum(x[2] for k, x in own[f].items() if k <= b)
                mid = (_weight(lg, lh, p.lambda_l2, node) + _weight(g - lg, h - lh, p.lambda_l2, node)) / 2
                (left.hi, right.lo) = (min(left.hi, mid), max(right.lo, mid)) if mono(f) > 0 else (left.hi, right.lo)
                (left.lo, right.hi) = (max(left.lo, mid), min(right.hi, mid)) if mono(f) < 0 else (left.lo, right.hi)
            node.left, node.right = len(tree.nodes), len(tree.nodes) + 1
            tree.nodes += [left, right]
            following += [node.left, node.right]
        open_ = following
    return _budget(tree, p)


def _budget(tree: Tree, p: TreeParams) -> Tree:
    """Preorder numbering; splits beyond ``max_leaves`` become leaves.

    Depth first, left child first; leaf-wise growth visits the child of larger
    gain first, so it spends the budget there.
    """
    out, leaves = Tree(), 1

    def visit(i: int) -> int:
        nonlocal leaves
        node = tree.nodes[i]
        at = len(out.nodes)
        copy = Node(node.depth, node.weight, node.lo, node.hi, node.groups)
        out.nodes.append(copy)
        if node.is_leaf or (p.max_leaves and leaves >= p.max_leaves):
            return at
        leaves += 1
        copy.feature, copy.bin, copy.left_bins, copy.gain = node.feature, node.bin, node.left_bins, node.gain
        order = [("left", node.left), ("right", node.right)]
        if p.grow_policy.lower() == "leafwise":
            order.sort(key=lambda x: -tree.nodes[x[1]].gain)
        for side, child in order:
            setattr(copy, side, visit(child))
        return at

    visit(0)
    return out
