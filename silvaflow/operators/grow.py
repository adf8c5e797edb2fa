"""Growing all trees of a forest together, one level at a time.

A level is a few aggregations keyed by (tree, node): node statistics, then for each drawn feature the distinct values with
their slot sums, prefix sums over them, and the best boundary. Rows are never moved by node: a row's node follows from the
splits so far, joined by broadcast (or shuffled on (tree, node) once a level has too many).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng
from ..plans.keep import FEW, cut, settle
from ..plans.prepare import Fit, bags, finite
from ..plans.schema import EPS, META_COLUMNS, MODEL_COLUMNS, NODE_COLUMNS

#: Rows in a node beyond which the prefix sums of one feature are spread over partitions.
SPREAD = 5_000_000
#: After so many levels the rows' nodes are written, so that the plan stays short.
WRITE_EVERY = 6


def weight_of(s: list[Column], is_class: bool) -> Column:
    return reduce(lambda a, b: a + b, s) if is_class else s[0]


def score_of(s: list[Column], criterion: str) -> Column:
    """Q: gains are Q(left) + Q(right) - Q(parent)."""
    if criterion == "mse":
        return F.try_divide(s[1] * s[1], s[0])
    w = weight_of(s, True)
    if criterion == "gini":
        return F.try_divide(reduce(lambda a, b: a + b, (x * x for x in s)), w)
    return reduce(lambda a, b: a + b, (F.when(x > 0, x * F.log2(F.try_divide(x, w))).otherwise(0.0) for x in s))


def impurity_of(s: list[Column], criterion: str) -> Column:
    if criterion == "mse":
        m = F.try_divide(s[1], s[0])
        return F.greatest(F.try_divide(s[2], s[0]) - m * m, F.lit(0.0))
    w = weight_of(s, True)
    p = [F.try_divide(x, w) for x in s]
    if criterion == "gini":
        return F.lit(1.0) - reduce(lambda a, b: a + b, (x * x for x in p))
    return -reduce(lambda a, b: a + b, (F.when(x > 0, x * F.log2(x)).otherwise(0.0) for x in p))


def slot_columns(p: Fit) -> list[Column]:
    """What a row of weight w adds to each slot."""
    w, y = F.col("w"), F.col("y")
    if p.is_class:
        return [F.when(y == c, w).otherwise(0.0) for c in p.classes]
    return [w, w * y, w * y * y]


class Grower:
    """key turns (tree, node, what) into the string of a draw; mtry and cap give a tree's values."""

    def __init__(self, p: Fit, key: Callable[[str, Column, Column, Column], Column] | None = None, mtry: Column | None = None, cap: Column | None = None, cap_max: int | None = None):
        self.p, self.k = p, p.slots
        self.key = key or (lambda mark, tree, node, what: F.concat_ws(":", F.lit(f"{p.seed}{mark}"), tree, node, what))
        self.mtry, self.cap, self.cap_max = mtry if mtry is not None else F.lit(p.mtry), cap if cap is not None else F.lit(p.max_depth), cap_max or p.max_depth
        self.names = F.array(*(F.lit(f) for f, _ in p.features))
        self.kinds = F.array(*(F.lit(k) for _, k in p.features))
        self.numeric = [k == "num" for _, k in p.features]
        self.s = [f"s{i}" for i in range(self.k)]

    def cols(self, prefix: str = "s") -> list[Column]:
        return [F.col(f"{prefix}{i}") for i in range(self.k)]

    def grow(self, rows: DataFrame, n_roots: int) -> DataFrame:
        """The nodes of all trees, n_roots of them. rows: tree, w, y, num, cat, one row for each tree and row of its bag."""
        p = self.p
        front = rows.withColumns({"node": F.lit(1).cast("long"), **dict(zip(self.s, slot_columns(p), strict=True))}).drop("y")
        front = cut(front)
        done, bound, depth = [], n_roots, 0
        self.n_roots = n_roots
        roots = None
        while True:
            stats, local = settle(self.node_stats(front), bound)
            if roots is None:
                roots = stats.select("tree", F.col("w_node").alias("w_root"))
            ready = stats.filter((F.lit(depth) < self.cap) & (F.col("n_rows") >= p.min_samples_split) & (F.col("impurity") > EPS))
            n_splits = 0
            self.bound = bound
            if depth < self.cap_max:
                largest = max(local.column("n_rows").to_pylist(), default=0) if local is not None else stats.agg(F.max("n_rows")).first()[0]
                chosen = self.lottery(ready)
                found = self.best_splits(front, ready, chosen, roots, largest, bound) if p.splitter == "best" else self.random_splits(front, ready, chosen, roots)
                best, local = settle(found, bound)
                n_splits = local.num_rows if local is not None else best.count()
            if not n_splits:
                done.append(self.leaves(stats, depth))
                break
            done += [self.splits(stats, best, depth), self.leaves(stats.join(_side(best.select("tree", "node"), bound), ["tree", "node"], "left_anti"), depth)]
            front = self.descended(front, best, bound)
            depth += 1
            if depth % WRITE_EVERY == 0:
                front = cut(front)
            bound = 2 * n_splits
        return reduce(DataFrame.unionByName, done)

    def node_stats(self, front: DataFrame) -> DataFrame:
        p = self.p
        least = [F.min(F.col("num")[j] if n else F.col("cat")[j]).alias(f"lo{j}") for j, n in enumerate(self.numeric)]
        most = [F.max(F.col("num")[j] if n else F.col("cat")[j]).alias(f"hi{j}") for j, n in enumerate(self.numeric)]
        out = front.groupBy("tree", "node").agg(F.count("*").alias("n_rows"), *(F.sum(s).alias(s) for s in self.s), *least, *most)
        s = self.cols()
        varies = F.filter(F.array(*(F.when(F.col(f"lo{j}") < F.col(f"hi{j}"), F.lit(j)) for j in range(len(self.numeric)))), lambda x: x.isNotNull())
        low = F.array(*(F.col(f"lo{j}") if n else F.lit(None).cast("double") for j, n in enumerate(self.numeric)))
        high = F.array(*(F.col(f"hi{j}") if n else F.lit(None).cast("double") for j, n in enumerate(self.numeric)))
        return out.select("tree", "node", "n_rows", *self.s, weight_of(s, p.is_class).alias("w_node"), impurity_of(s, p.criterion).alias("impurity"), score_of(s, p.criterion).alias("q_node"), varies.alias("varies"), low.alias("low"), high.alias("high"))

    def lottery(self, ready: DataFrame) -> DataFrame:
        """tree, node, js: the drawn features of each node, of those that vary in it."""
        each = ready.select("tree", "node", F.explode("varies").alias("j"))
        key = self.key("", F.col("tree"), F.col("node"), self.names[F.col("j")])
        drawn = each.groupBy("tree", "node").agg(F.sort_array(F.collect_list(F.struct(rng.rank_key(key).alias("r"), "j"))).alias("all"))
        return drawn.select("tree", "node", F.transform(F.slice("all", 1, self.mtry), lambda x: x.j).alias("js"))

    def drawn_cells(self, front: DataFrame, chosen: DataFrame) -> DataFrame:
        joined = front.join(_side(chosen, self.bound), ["tree", "node"])
        each = joined.select("tree", "node", "w", "num", "cat", *self.s, F.explode("js").alias("j"))
        return each.select("tree", "node", "j", F.col("num")[F.col("j")].alias("v"), F.col("cat")[F.col("j")].alias("lv"), *self.s)

    def buckets(self, front: DataFrame, chosen: DataFrame) -> DataFrame:
        """The distinct values of each drawn feature in each node, in each ordering to be tried."""
        p = self.p
        b = self.drawn_cells(front, chosen).groupBy("tree", "node", "j", "v", "lv").agg(F.count("*").alias("bn"), *(F.sum(s).alias(s) for s in self.s))
        s = self.cols()
        if p.is_class:
            w = weight_of(s, True)
            orders = F.array(*(F.struct(F.lit(i + 1).alias("ord"), F.coalesce(F.try_divide(x, w), F.lit(0.0)).alias("skey")) for i, x in enumerate(s)))
        else:
            orders = F.array(F.struct(F.lit(1).alias("ord"), F.coalesce(F.try_divide(s[1], s[0]), F.lit(0.0)).alias("skey")))
        own = F.when(F.col("lv").isNull(), F.array(F.struct(F.lit(0).alias("ord"), F.col("v").alias("skey")))).otherwise(orders)
        return b.select("tree", "node", "j", "lv", "bn", *self.s, F.inline(own))

    def prefixes(self, b: DataFrame, largest: int) -> DataFrame:
        keys = ["tree", "node", "j", "ord"]
        summed = {"nl": "bn", **{f"l{i}": s for i, s in enumerate(self.s)}}
        if largest <= SPREAD:
            w = Window.partitionBy(*keys).orderBy("skey", "lv")
            upto = w.rowsBetween(Window.unboundedPreceding, 0)
            return b.withColumns({**{n: F.sum(c).over(upto) for n, c in summed.items()}, "next": F.lead("skey").over(w)})
        # too many values for one task: sort them over partitions, sum within each, and add what lies in those before
        b = cut(b.repartitionByRange(*keys, "skey", "lv")).withColumn("part", F.spark_partition_id())
        w = Window.partitionBy(*keys, "part").orderBy("skey", "lv")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        local = b.withColumns({**{n: F.sum(c).over(upto) for n, c in summed.items()}, "next": F.lead("skey").over(w)})
        parts = b.groupBy(*keys, "part").agg(F.min("skey").alias("lowest"), *(F.sum(c).alias(f"t_{n}") for n, c in summed.items()))
        over = Window.partitionBy(*keys).orderBy("part")
        before = over.rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(*keys, "part", F.lead("lowest").over(over).alias("after"), *(F.coalesce(F.sum(f"t_{n}").over(before), F.lit(0)).alias(f"b_{n}") for n in summed))
        out = local.join(parts, [*keys, "part"])
        return out.withColumns({**{n: F.col(n) + F.col(f"b_{n}") for n in summed}, "next": F.coalesce("next", "after")}).drop("part", "after", *(f"b_{n}" for n in summed))

    def best_splits(self, front: DataFrame, ready: DataFrame, chosen: DataFrame, roots: DataFrame, largest: int, bound: int) -> DataFrame:
        p = self.p
        pre = self.prefixes(self.buckets(front, chosen), largest)
        node = ready.select("tree", "node", "n_rows", "w_node", "q_node", *(F.col(s).alias(f"p{i}") for i, s in enumerate(self.s)))
        both = pre.join(_side(node, bound), ["tree", "node"]).join(_side(roots, self.n_roots), "tree")
        left, right = self.cols("l"), [F.col(f"p{i}") - F.col(f"l{i}") for i in range(self.k)]
        gain = score_of(left, p.criterion) + score_of(right, p.criterion) - F.col("q_node")
        both = both.withColumns({"gain": gain, "wl": weight_of(left, p.is_class)}).filter(
            F.col("next").isNotNull() & (F.col("nl") >= p.min_samples_leaf) & (F.col("n_rows") - F.col("nl") >= p.min_samples_leaf)
            & F.col("gain").isNotNull() & finite(F.col("gain")) & (F.try_divide(F.col("gain"), F.col("w_root")) + EPS >= p.min_impurity_decrease)
        )
        order = F.struct((-F.col("gain")).alias("g"), "j", "ord", "skey", "lv")
        top = both.groupBy("tree", "node").agg(F.min_by(F.struct("j", "ord", "skey", "lv", "next", "gain", "wl", "w_node"), order).alias("b")).select("tree", "node", "b.*")
        kind = self.kinds[F.col("j")]
        mid = (F.col("skey") + F.col("next")) / 2
        thr = F.when(kind == "num", F.when(finite(mid) & (mid < F.col("next")), mid).otherwise(F.col("skey")))
        top = top.withColumns({"kind": kind, "thr": thr})
        if "cat" not in [k for _, k in p.features]:
            return top.select("tree", "node", "j", "gain", "kind", "thr", "wl", (F.col("w_node") - F.col("wl")).alias("wr"), *_no_levels())
        top, _ = settle(top, bound)
        won = top.filter("kind = 'cat'")
        key = _side(won.select("tree", "node", "j", "ord", F.col("skey").alias("k"), F.col("lv").alias("kl")), bound)
        goes_left = (F.col("skey") < F.col("k")) | ((F.col("skey") == F.col("k")) & (F.col("lv") <= F.col("kl")))
        levels = self.buckets(front, won.select("tree", "node", F.array("j").alias("js"))).join(key, ["tree", "node", "j", "ord"])
        levels = levels.groupBy("tree", "node").agg(F.sort_array(F.collect_list(F.when(goes_left, F.col("lv")))).alias("cats_left"), F.sort_array(F.collect_list(F.when(~goes_left, F.col("lv")))).alias("cats_right"))
        return top.join(levels, ["tree", "node"], "left").select("tree", "node", "j", "gain", "kind", "thr", "wl", (F.col("w_node") - F.col("wl")).alias("wr"), "cats_left", "cats_right")

    def random_splits(self, front: DataFrame, ready: DataFrame, chosen: DataFrame, roots: DataFrame) -> DataFrame:
        p = self.p
        name = self.names[F.col("j")]
        tree, node = F.col("tree"), F.col("node")
        drawn = chosen.join(ready.select("tree", "node", "low", "high"), ["tree", "node"]).select("tree", "node", F.explode("js").alias("j"), "low", "high")
        lo, hi = F.col("low")[F.col("j")], F.col("high")[F.col("j")]
        thr = lo + rng.draw_unit(self.key(":RT", tree, node, name)) * (hi - lo)
        drawn = drawn.select("tree", "node", "j", thr.alias("thr"))
        cells = self.drawn_cells(front, chosen).join(_side(drawn, self.bound * len(p.features)), ["tree", "node", "j"])
        coin = rng.draw_is_even(F.concat_ws(":", self.key(":RC", tree, node, name), F.col("lv")))
        cells = cells.withColumn("left", F.when(F.col("lv").isNull(), F.col("v") <= F.col("thr")).otherwise(coin))
        sums = cells.groupBy("tree", "node", "j").agg(
            F.max("thr").alias("thr"), F.count_if("left").alias("nl"), *(F.sum(F.when(F.col("left"), F.col(s)).otherwise(0.0)).alias(f"l{i}") for i, s in enumerate(self.s)),
            F.sort_array(F.collect_set(F.when(F.col("left"), F.col("lv")))).alias("cats_left"), F.sort_array(F.collect_set(F.when(~F.col("left"), F.col("lv")))).alias("cats_right"),
        )
        stat = ready.select("tree", "node", "n_rows", "w_node", "q_node", *(F.col(s).alias(f"p{i}") for i, s in enumerate(self.s)))
        both = sums.join(_side(stat, self.bound), ["tree", "node"]).join(_side(roots, self.n_roots), "tree")
        left, right = self.cols("l"), [F.col(f"p{i}") - F.col(f"l{i}") for i in range(self.k)]
        both = both.withColumns({"gain": score_of(left, p.criterion) + score_of(right, p.criterion) - F.col("q_node"), "wl": weight_of(left, p.is_class), "kind": self.kinds[F.col("j")]}).filter(
            (F.col("nl") >= p.min_samples_leaf) & (F.col("n_rows") - F.col("nl") >= p.min_samples_leaf) & F.col("gain").isNotNull() & finite(F.col("gain"))
            & (F.try_divide(F.col("gain"), F.col("w_root")) + EPS >= p.min_impurity_decrease)
        )
        top = both.groupBy("tree", "node").agg(F.min_by(F.struct("j", "gain", "kind", "thr", "wl", (F.col("w_node") - F.col("wl")).alias("wr"), "cats_left", "cats_right"), F.struct((-F.col("gain")).alias("g"), "j")).alias("b"))
        return top.select("tree", "node", "b.*").withColumns({c: F.when(F.col("kind") == "cat", F.col(c)) for c in ("cats_left", "cats_right")})

    def splits(self, stats: DataFrame, best: DataFrame, depth: int) -> DataFrame:
        joined = stats.join(_side(best, self.bound), ["tree", "node"])
        return self.nodes(joined, depth, is_leaf=F.lit(False), split_feature=self.names[F.col("j")], split_kind=F.col("kind"), threshold=F.col("thr"), cats_left=F.col("cats_left"), cats_right=F.col("cats_right"), unseen_left=F.col("wl") >= F.col("wr"), imp_decrease=F.col("gain"))

    def leaves(self, stats: DataFrame, depth: int) -> DataFrame:
        s = self.cols()
        if self.p.is_class:
            return self.nodes(stats, depth, is_leaf=F.lit(True), class_counts=F.map_from_arrays(F.array(*map(F.lit, self.p.classes)), F.array(*s)))
        return self.nodes(stats, depth, is_leaf=F.lit(True), prediction=F.try_divide(s[1], s[0]) + F.lit(self.p.centre))

    def nodes(self, df: DataFrame, depth: int, **given: Column) -> DataFrame:
        known = {"tree": F.col("tree"), "node": F.col("node"), "depth": F.lit(depth), "n_rows": F.col("n_rows"), "w_node": F.col("w_node"), "impurity": F.col("impurity"), **given}
        return df.select(*(known.get(c, F.lit(None)).cast(t).alias(c) for c, t in NODE_COLUMNS.items()))

    def descended(self, front: DataFrame, best: DataFrame, bound: int) -> DataFrame:
        """The rows of nodes that were split, in the children."""
        b = _side(best.select("tree", "node", "j", "kind", "thr", "cats_left"), bound)
        goes_left = F.when(F.col("kind") == "num", F.col("num")[F.col("j")] <= F.col("thr")).otherwise(F.array_contains("cats_left", F.col("cat")[F.col("j")]))
        child = F.col("node") * 2 + F.when(goes_left, 0).otherwise(1)
        return front.join(b, ["tree", "node"]).withColumn("node", child.cast("long")).drop("j", "kind", "thr", "cats_left")


def _side(df: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(df) if bound <= FEW else df


def _no_levels() -> list[Column]:
    return [F.lit(None).cast("array<string>").alias(c) for c in ("cats_left", "cats_right")]


def with_meta(p: Fit, nodes: DataFrame) -> DataFrame:
    """nodes with what holds for the whole forest on each row: a model table."""
    meta = {
        **{c: F.lit(getattr(p, c)) for c in ("family", "n_trees", "seed", "sample_frac", "replace_sample", "n_train", "mtry", "max_depth", "min_samples_split", "min_samples_leaf", "min_impurity_decrease", "criterion", "splitter")},
        "features": F.array(*(F.lit(f) for f, _ in p.features)),
        "feature_kinds": F.array(*(F.lit(k) for _, k in p.features)),
        "classes": F.array(*map(F.lit, p.classes)) if p.classes else F.lit(None),
        "train_hash": F.lit(str(p.train_hash)),
    }
    return nodes.select(*NODE_COLUMNS, *(meta[c].cast(t).alias(c) for c, t in META_COLUMNS.items())).select(*MODEL_COLUMNS)


def bagged(p: Fit, rows: DataFrame) -> DataFrame:
    """tree, w, y, num, cat: the bags of trees tree_from..tree_to with the rows' contents."""
    drawn = bags(rows.sparkSession, list(range(p.tree_from, p.tree_to + 1)), p.seed, p.n_train, p.sample_frac, p.replace_sample)
    return drawn.join(rows, "i").select("tree", (F.col("w") * F.col("n_drawn")).alias("w"), "y", "num", "cat")
