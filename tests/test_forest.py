import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import silvaflow as sf
from silvaflow.functions import rng
from silvaflow.operators import descend, grow, score
from silvaflow.plans import prepare


def draw(key: str) -> int:
    return int.from_bytes(hashlib.md5(key.encode()).digest(), "little")


@pytest.fixture(scope="module")
def reg(spark):
    rows = [(i, i % 7 - 3, float(2 + 3 * i - (i % 7 - 3))) for i in range(200)]
    return spark.createDataFrame(rows, "x1 long, x2 long, y double").cache()


@pytest.fixture(scope="module")
def clf(spark):
    rows = [(i, 13 * i % 20, "abc"[i % 3], "yes" if i % 10 < 6 else "no") for i in range(240)]
    return spark.createDataFrame(rows, "x1 long, x2 long, g string, y string").cache()


def rows_of(df, *order):
    return [tuple(str(v) for v in r) for r in df.orderBy(*order).collect()]


def test_draws(spark):
    keys = [f"42:{t}:{k}" for t in range(1, 5) for k in range(1, 60)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    k = F.col("k")
    got = df.select("k", rng.rank_key(k).alias("r"), rng.draw_mod(k, 1501).alias("m"), rng.draw_mod_large(k).alias("big"), rng.draw_unit(k).alias("u"), rng.draw_is_even(k).alias("e")).collect()
    for r in got:
        d = draw(r.k)
        assert (r.m, r.big, r.u, r.e) == (d % 1501, d % rng.BIG_PRIME, d % 2**53 / 2**53, d % 2 == 0)
    assert [r.k for r in sorted(got, key=lambda r: r.r)] == sorted(keys, key=draw)


@pytest.mark.parametrize("replace,frac", [(True, 1.0), (True, 0.5), (False, 0.4), (False, 1.0)])
def test_bags(spark, replace, frac):
    n = 101
    got = {(r.tree, r.i): r.n_drawn for r in prepare.bags(spark, [2, 3], 7, n, frac, replace).collect()}
    want = {}
    m = max(1, math.ceil(frac * n))
    for t in (2, 3):
        if replace:
            for k in range(1, m + 1):
                key = (t, draw(f"7:{t}:{k}") % n + 1)
                want[key] = want.get(key, 0) + 1
        else:
            for i in sorted(range(1, n + 1), key=lambda i: draw(f"7:{t}:{i}"))[:m]:
                want[(t, i)] = 1
    assert got == want


class Tree:
    """A plain grower of one tree on numbers and levels, to compare with."""

    def __init__(self, x, y, w, names, classes=None, criterion="gini", depth=60, mtry=None, seed=42, tree=1, random=False, msl=1):
        self.x, self.y, self.w, self.names, self.classes, self.criterion, self.cap = x, y, w, names, classes, criterion, depth
        self.mtry, self.seed, self.tree, self.random, self.msl = mtry or len(names), seed, tree, random, msl
        self.nodes = {}
        self.grow(1, 0, [i for i in range(len(y)) if w[i] > 0])

    def slots(self, rows):
        if self.classes:
            return [sum(self.w[i] for i in rows if self.y[i] == c) for c in self.classes]
        return [sum(self.w[i] for i in rows), sum(self.w[i] * self.y[i] for i in rows), sum(self.w[i] * self.y[i] ** 2 for i in rows)]

    def q(self, s):
        if not self.classes:
            return s[1] ** 2 / s[0]
        t = sum(s)
        return sum(v * v for v in s) / t if self.criterion == "gini" else sum(v * math.log2(v / t) for v in s if v > 0)

    def impurity(self, s):
        if not self.classes:
            return max(s[2] / s[0] - (s[1] / s[0]) ** 2, 0)
        t = sum(s)
        return 1 - sum((v / t) ** 2 for v in s) if self.criterion == "gini" else -sum(v / t * math.log2(v / t) for v in s if v > 0)

    def grow(self, node, depth, rows):
        s = self.slots(rows)
        self.nodes[node] = None
        if depth >= self.cap or len(rows) < 2 or self.impurity(s) <= 2.3e-16:
            return
        varies = [j for j in range(len(self.names)) if len({self.x[i][j] for i in rows}) > 1]
        drawn = sorted(varies, key=lambda j: draw(f"{self.seed}:{self.tree}:{node}:{self.names[j]}"))[: self.mtry]
        best = None
        for j in sorted(drawn):
            for key, left in self.candidates(node, j, rows):
                right = [i for i in rows if i not in left]
                if min(len(left), len(right)) < self.msl:
                    continue
                gain = self.q(self.slots(left)) + self.q(self.slots(right)) - self.q(s)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, j, key, left)
        if best is None:
            return
        left = best[3]
        self.nodes[node] = (self.names[best[1]], best[2], best[0])
        self.grow(2 * node, depth + 1, sorted(left))
        self.grow(2 * node + 1, depth + 1, [i for i in rows if i not in left])

    def candidates(self, node, j, rows):
        values = sorted({self.x[i][j] for i in rows})
        if self.random:
            if isinstance(values[0], str):
                left = {v for v in values if draw(f"{self.seed}:RC:{self.tree}:{node}:{self.names[j]}:{v}") % 2 == 0}
                yield frozenset(left), {i for i in rows if self.x[i][j] in left}
            else:
                u = draw(f"{self.seed}:RT:{self.tree}:{node}:{self.names[j]}") % 2**53 / 2**53
                t = values[0] + u * (values[-1] - values[0])
                yield t, {i for i in rows if self.x[i][j] <= t}
            return
        if isinstance(values[0], str):
            for k in range(len(self.classes) if self.classes else 1):

                def share(v, k=k):
                    s = self.slots([i for i in rows if self.x[i][j] == v])
                    return (s[k] / sum(s) if self.classes else s[1] / s[0], v)

                order = sorted(values, key=share)
                for e in range(1, len(order)):
                    yield frozenset(order[:e]), {i for i in rows if self.x[i][j] in order[:e]}
        else:
            for a, b in zip(values, values[1:]):
                yield (a + b) / 2, {i for i in rows if self.x[i][j] <= a}


def compare(model, tree: Tree, number: int = 1):
    got = {r.node: r for r in model.filter(F.col("tree") == number).collect()}
    assert set(got) == set(tree.nodes)
    for node, want in tree.nodes.items():
        r = got[node]
        assert r.is_leaf == (want is None)
        if want:
            assert r.split_feature == want[0]
            assert r.imp_decrease == pytest.approx(want[2], abs=1e-6)
            if r.split_kind == "cat":
                assert frozenset(r.cats_left) == want[1]
            else:
                assert r.threshold == pytest.approx(want[1], abs=1e-9)


def bag_weights(n, seed, tree):
    w = [0] * n
    for k in range(1, n + 1):
        w[draw(f"{seed}:{tree}:{k}") % n] += 1
    return w


@pytest.mark.parametrize("criterion,splitter", [("gini", "best"), ("entropy", "best"), ("gini", "random")])
def test_classification_trees(clf, criterion, splitter):
    model = sf.fit_classifier(clf, "y", n_trees=2, max_depth=3, criterion=criterion, splitter=splitter, seed=5, min_samples_leaf=3, order_by=["x1"])
    data = clf.orderBy("x1").collect()
    for t in (1, 2):
        tree = Tree([(r.g, r.x1, r.x2) for r in data], [r.y for r in data], bag_weights(240, 5, t), ["g", "x1", "x2"], ["no", "yes"], criterion, 3, 1, 5, t, splitter == "random", 3)
        compare(model, tree, t)


@pytest.mark.parametrize("splitter", ["best", "random"])
def test_regression_trees(clf, splitter):
    df = clf.withColumn("y", (F.col("x2") * 3 + F.when(F.col("g") == "b", 40).otherwise(0)).cast("double"))
    model = sf.fit_regressor(df, "y", n_trees=2, mtry=2, max_depth=3, seed=9, splitter=splitter, order_by=["x1"])
    data = df.orderBy("x1").collect()
    centre = round(np.mean([r.y for r in data]))
    for t in (1, 2):
        compare(model, Tree([(r.g, r.x1, r.x2) for r in data], [r.y - centre for r in data], bag_weights(240, 9, t), ["g", "x1", "x2"], None, "mse", 3, 2, 9, t, splitter == "random"), t)


def test_spread_prefixes_are_the_same(clf, monkeypatch):
    args = dict(n_trees=2, max_depth=3, seed=5, order_by=["x1"])
    want = rows_of(sf.fit_classifier(clf, "y", **args).select("tree", "node", "split_feature", "threshold", "cats_left", "imp_decrease"), "tree", "node")
    monkeypatch.setattr(grow, "SPREAD", 10)
    assert rows_of(sf.fit_classifier(clf, "y", **args).select("tree", "node", "split_feature", "threshold", "cats_left", "imp_decrease"), "tree", "node") == want


def test_batches_are_the_forest(clf):
    args = dict(n_trees=4, max_depth=2, seed=3, order_by=["x1"])
    whole = sf.fit_classifier(clf, "y", **args)
    parts = sf.fit_batched(clf, "y", "classification", batch_size=3, **args)
    assert rows_of(whole, "tree", "node") == rows_of(parts, "tree", "node")
    assert sf.batch_ranges(10, 4) == [(1, 4), (5, 8), (9, 10)]
    assert "tree_from=5, tree_to=8" in sf.batched_fit_plan("t", "y", "classification", 10, 4, seed=1)


def test_exact_tree_and_metrics(spark, reg):
    model = sf.fit_regressor(reg, "y", n_trees=1, max_depth=None, sample_frac=1.0, replace_sample=False, order_by=["x1"]).cache()
    out = sf.evaluate_regressor(model, reg, "y").first()
    assert out.n == 200 and out.rmse == pytest.approx(0, abs=1e-9) and out.r2 == pytest.approx(1)
    s = sf.summary(model).first()
    assert (s.n_trees, s.n_leaves, s.n_nodes, s.depth_cap_hit, s.max_depth) == (1, 200, 399, False, 60)
    imp = {r.feature: r.importance for r in sf.importance(model).collect()}
    assert sum(imp.values()) == pytest.approx(1) and imp["x1"] > 0.99


def test_predict_ways_agree(spark, clf, monkeypatch):
    model = sf.fit_classifier(clf, "y", n_trees=3, max_depth=3, seed=4, order_by=["x1"]).cache()
    new = spark.createDataFrame([(5, 3, "a", None), (None, 3, "b", "no"), (7, 2, "never", "yes"), (8, 1, None, "no")], "x1 long, x2 long, g string, y string")
    for action in ("null", "skip_tree"):
        monkeypatch.setattr(score, "ARRAY_NODES", 10**6)
        fast = sf.predict_classifier(model, new, action).collect()
        monkeypatch.setattr(score, "ARRAY_NODES", 0)
        slow = sf.predict_classifier(model, new, action).collect()
        key = lambda r: (str(r.x1), str(r.g), r.pred, None if r.probs is None else {k: round(v, 12) for k, v in r.probs.items()})
        assert sorted(map(str, map(key, fast))) == sorted(map(str, map(key, slow)))
    monkeypatch.undo()
    got = {r.x1: r for r in sf.predict_classifier(model, new).collect()}
    assert got[None].pred is None and got[8].pred is None and got[7].pred in ("yes", "no")
    assert sf.predict_classifier(model, new.limit(0)).count() == 0
    assert sf.predict_classifier(model, new.drop("g")).filter("pred is not null").count() == 0
    one = sf.predict_classifier(model, clf, n_trees=1)
    per = sf.predict_trees_classifier(model, clf, order_by=["x1"]).filter("tree = 1")
    assert sorted(r.pred for r in one.collect()) == sorted(r.pred for r in per.collect())


def test_oob(clf):
    model = sf.fit_classifier(clf, "y", n_trees=4, max_depth=3, seed=5, order_by=["x1"]).cache()
    out = sf.oob_predict_classifier(model, clf, order_by=["x1"])
    inside = {t: bag_weights(240, 5, t) for t in range(1, 5)}
    got = {r.x1: r.pred for r in out.collect()}
    assert all((got[i] is None) == all(inside[t][i] > 0 for t in inside) for i in range(240))
    m = sf.oob_classifier(model, clf, "y", order_by=["x1"]).first()
    assert m.n + m.n_excluded == 240 and 0 <= m.auc <= 1
    with pytest.raises(sf.ForestError, match="complete rows"):
        sf.oob_predict_classifier(model, clf.filter("x1 > 0"), order_by=["x1"])
    with pytest.raises(sf.ForestError, match="fingerprint"):
        sf.oob_predict_classifier(model, clf.withColumn("x2", F.when(F.col("x1") == 3, 99).otherwise(F.col("x2"))), order_by=["x1"])


def test_quantiles(spark):
    df = spark.createDataFrame([(i // 20, float(100 * (i // 20) + i % 20)) for i in range(200)], "x1 long, y double")
    model = sf.fit_regressor(df, "y", n_trees=1, max_depth=None, min_samples_leaf=20, replace_sample=False, order_by=["y"])
    got = {r.x1: r.quantile_pred for r in sf.predict_quantiles(model, df, "y", [0.05, 0.5, 0.95]).collect()}
    assert all(got[k] == {0.05: 100.0 * k, 0.5: 100.0 * k + 9, 0.95: 100.0 * k + 18} for k in range(10))


def test_permutation_replay(clf):
    df = clf.withColumn("y", (F.col("x2") * 2 + F.when(F.col("g") == "b", 7).otherwise(0)).cast("double"))
    model = sf.fit_regressor(df, "y", n_trees=2, max_depth=4, seed=4, order_by=["x1"]).cache()
    got = {r.feature: r for r in sf.permutation_importance(model, df, "y", n_repeats=2, seed=11, order_by=["x1"]).collect()}
    data = df.orderBy("x1").toPandas()
    n = len(data)

    def r2(frame):
        out = sf.predict_regressor(model, clf.sparkSession.createDataFrame(frame)).toPandas().sort_values("k")
        y = data.y.to_numpy()
        return 1 - ((y - out.prediction.to_numpy()) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    base = r2(data.assign(k=range(n)))
    for f in ("x2", "g"):
        losses = []
        for rep in (1, 2):
            order = sorted(range(1, n + 1), key=lambda i: draw(f"11:P:{f}:{rep}:{i}"))
            losses.append(base - r2(data.assign(k=range(n), **{f: [data[f][i - 1] for i in order]})))
        assert got[f].importance == pytest.approx(np.mean(losses), abs=1e-9)
        assert got[f].importance_std == pytest.approx(np.std(losses), abs=1e-9)


def test_cv_replay(clf):
    grid, k, trees = [1, 2], 3, 2
    out = {r.mtry: r.cv_error for r in sf.cv_mtry(clf, "y", "classification", grid, k=k, n_trees=trees, max_depth=2, seed=8, order_by=["x1"]).collect()}
    data = clf.orderBy("x1").collect()
    n, names = len(data), ["g", "x1", "x2"]
    x, y = [(r.g, r.x1, r.x2) for r in data], [r.y for r in data]
    for gi, mtry in enumerate(grid):
        wrong = 0
        for held in range(k):
            g = gi * k + held
            train = [i for i in range(n) if i % k != held]
            shares = {i: [] for i in range(n) if i % k == held}
            for t in range(1, trees + 1):
                w = [0] * n
                for d in range(1, len(train) + 1):
                    w[train[draw(f"8:cv:{g}:{t}:{d}") % len(train)]] += 1

                class CvTree(Tree):
                    def grow(self, node, depth, rows):
                        self.members = getattr(self, "members", {})
                        self.members[node] = rows
                        super().grow(node, depth, rows)

                original = draw
                tree = CvTree(x, y, w, names, ["no", "yes"], "gini", 2, mtry, f"8:cv:{g}", t)
                assert original is draw
                for i in shares:
                    node = 1
                    while tree.nodes[node]:
                        f, key, _ = tree.nodes[node]
                        v = x[i][names.index(f)]
                        if isinstance(v, str):
                            seen = {x[r][names.index(f)] for r in tree.members[node]}
                            big = sum(w[r] for r in tree.members[2 * node]) >= sum(w[r] for r in tree.members[2 * node + 1])
                            left = v in key or (v not in seen and big)
                        else:
                            left = v <= key
                        node = 2 * node + (not left)
                    s = tree.slots(tree.members[node])
                    shares[i].append(s[0] / sum(s))
            wrong += sum(("no" if np.mean(p) >= 0.5 else "yes") != y[i] for i, p in shares.items())
        assert out[mtry] == pytest.approx(wrong / n)
    deep = sf.cv_depth(clf, "y", "classification", [1, 2], k=2, n_trees=1, order_by=["x1"]).collect()
    assert [r.max_depth for r in deep] == [1, 2] and all(0 <= r.cv_error <= 1 for r in deep)


def test_weights(spark, clf):
    weighted = clf.withColumn("w", (1 + F.col("x1") % 3).cast("double"))
    model = sf.fit_classifier(weighted, "y", n_trees=1, max_depth=1, weights_col="w", replace_sample=False, order_by=["x1"])
    root = model.filter("node = 1").first()
    assert root.w_node == sum(1 + i % 3 for i in range(240)) and root.n_rows == 240
    balanced = sf.fit_classifier(clf, "y", n_trees=1, max_depth=1, class_weight="balanced", replace_sample=False, order_by=["x1"]).filter("node = 1").first()
    assert balanced.w_node == pytest.approx(240) and balanced.impurity == pytest.approx(0.5)


def test_save_load_and_stream(spark, clf, tmp_path):
    model = sf.fit_classifier(clf, "y", n_trees=2, max_depth=2, order_by=["x1"])
    sf.save_model(model, f"{tmp_path}/m")
    back = sf.load_model(spark, f"{tmp_path}/m")
    assert rows_of(model, "tree", "node") == rows_of(back, "tree", "node")
    clf.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(clf.schema).parquet(f"{tmp_path}/in")
    sf.write_scores(back, stream, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    want = sorted((r.x1, r.pred) for r in sf.predict_classifier(back, clf).collect())
    assert sorted((r.x1, r.pred) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want
    model.createOrReplaceTempView("m_view")
    clf.createOrReplaceTempView("t_view")
    assert sf.evaluate_classifier("m_view", "t_view", "y").first().n == 240


GUARDS = [
    (dict(outcome="nope"), "nope"), (dict(outcome="y", n_trees=0), "n_trees"), (dict(outcome="y", mtry=9), "mtry"), (dict(outcome="y", max_depth=61), "max_depth"), (dict(outcome="y", min_samples_split=1), "min_samples_split"),
    (dict(outcome="y", min_samples_leaf=0), "min_samples_leaf"), (dict(outcome="y", min_impurity_decrease=-1.0), "min_impurity_decrease"), (dict(outcome="y", sample_frac=0.0), "sample_frac"), (dict(outcome="y", criterion="mse"), "criterion"),
    (dict(outcome="y", criterion=None), "criterion"), (dict(outcome="y", class_weight="x"), "class_weight"), (dict(outcome="y", seed=None), "seed"), (dict(outcome="y", tree_from=3, tree_to=2), "tree_from"), (dict(outcome="y", splitter=None), "splitter"),
    (dict(outcome="y", weights_col="nope"), "weights"),
]


@pytest.mark.parametrize("args,match", GUARDS)
def test_fit_guards(clf, args, match):
    with pytest.raises(sf.ForestError, match=match):
        sf.fit_classifier(clf, **args)


def test_table_guards(spark, clf, reg):
    bad = [
        (clf.limit(0), "y", "empty"), (clf.withColumn("__rf_x", F.lit(1)), "y", "reserved"), (clf.withColumn("d", F.current_date()), "y", "unsupported"), (clf.withColumn("pred", F.lit(1)), "y", "pred"),
        (clf.withColumn("n", F.lit(None).cast("double")), "y", "entirely NULL"), (clf.withColumn("y", F.lit(None).cast("string")), "y", "entirely NULL"), (clf.withColumn("x2", F.lit(float("nan"))), "y", "NaN"),
        (clf.withColumn("y", F.lit("one")), "y", "single class"), (clf.select("y"), "y", "no feature"),
    ]
    for df, outcome, match in bad:
        with pytest.raises(sf.ForestError, match=match):
            sf.fit_classifier(df, outcome)
    with pytest.raises(sf.ForestError, match="numeric"):
        sf.fit_regressor(clf, "y")
    with pytest.raises(sf.ForestError, match="weights"):
        sf.fit_regressor(reg.withColumn("w", F.lit(-1.0)), "y", weights_col="w")
    model = sf.fit_regressor(reg, "y", n_trees=1, max_depth=1).cache()
    for call, match in [
        (lambda: sf.predict_classifier(model, reg), "regression"), (lambda: sf.predict_regressor(model.limit(0), reg), "empty"), (lambda: sf.predict_regressor(model, reg.withColumn("Prediction", F.lit(1))), "collides"),
        (lambda: sf.predict_regressor(model, reg, na_action="x"), "na_action"), (lambda: sf.predict_regressor(model, reg, na_action=None), "na_action"), (lambda: sf.predict_regressor(model, reg, n_trees=0), "n_trees"),
        (lambda: sf.evaluate_regressor(model, reg.limit(0), "y"), "no rows"), (lambda: sf.predict_quantiles(model, reg, "y", []), "quantiles"), (lambda: sf.predict_quantiles(model, reg, "y", [1.0]), "quantiles"),
        (lambda: sf.permutation_importance(model, reg, "y", n_repeats=0), "n_repeats"), (lambda: sf.permutation_importance(model, reg, "z"), "z"), (lambda: sf.cv_mtry(reg, "y", "other", [1]), "family"),
        (lambda: sf.cv_mtry(reg, "y", "regression", [1], k=1), "k must"), (lambda: sf.cv_mtry(reg, "y", "regression", []), "grid"), (lambda: sf.cv_mtry(reg, "y", "regression", [3]), "mtry"),
        (lambda: sf.cv_depth(reg, "y", "regression", [61]), "depth"), (lambda: sf.batch_ranges(0), "n_trees"), (lambda: sf.batch_ranges(1, 0), "batch_size"), (lambda: sf.fit_batched(reg, "y", "x"), "family"),
        (lambda: sf.predict_regressor("__rf_m", reg), "reserved"),
    ]:
        with pytest.raises(sf.ForestError, match=match):
            call()
    assert descend.RID not in sf.predict_regressor(model, reg).columns


def test_named_features_leave_keys_out(spark, clf):
    keyed = clf.withColumn("key", F.col("x1") * 3 + 1)
    model = sf.fit_classifier(keyed, "y", n_trees=2, max_depth=2, order_by=["key"], features=["x1", "x2"])
    plain = sf.fit_classifier(clf, "y", n_trees=2, max_depth=2, order_by=["x1"], features=["x1", "x2"])
    columns = ("tree", "node", "split_feature", "threshold", "n_rows")
    assert sorted(map(str, model.select(*columns).collect())) == sorted(map(str, plain.select(*columns).collect()))
    assert set(model.first().features) == {"x1", "x2"}
    assert sf.oob_predict_classifier(model, keyed, order_by=["key"]).count() == 240
    with pytest.raises(sf.ForestError, match="nope"):
        sf.fit_classifier(clf, "y", features=["x1", "nope"])


def test_reserved_names_and_many_classes(spark, reg, clf):
    model = sf.fit_regressor(reg, "y", n_trees=1, max_depth=1).cache()
    calls = [sf.predict_trees_regressor, sf.oob_predict_regressor, lambda m, t: sf.evaluate_regressor(m, t, "y"), lambda m, t: sf.oob_regressor(m, t, "y")]
    for call in calls:
        with pytest.raises(sf.ForestError, match="reserved"):
            call(model, "__rf_t")
    for call in (sf.importance, sf.summary):
        with pytest.raises(sf.ForestError, match="reserved"):
            call("__rf_m")
    many = spark.range(1200).select(F.col("id").cast("string").alias("y"), F.col("id").alias("x"))
    with pytest.raises(sf.ForestError, match="classes"):
        sf.fit_classifier(many, "y", n_trees=1)


def test_batched_plan_is_the_batched_fit(spark, clf):
    clf.createOrReplaceTempView("plan_view")
    text = sf.batched_fit_plan("plan_view", "y", "classification", n_trees=3, batch_size=2, max_depth=2, order_by=["x1"])
    found = eval(text, {"fit_classifier": sf.fit_classifier})  # noqa: S307
    want = sf.fit_batched(clf, "y", "classification", n_trees=3, batch_size=2, max_depth=2, order_by=["x1"])
    columns = ("tree", "node", "split_feature", "threshold", "n_rows", "w_node")
    assert sorted(map(str, found.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
