"""DuckDB SQL for what the engine computes, unrolled level by level: the other side of each registered query."""

from __future__ import annotations

from dataclasses import dataclass, field

EPS = 2.220446049250313e-16


@dataclass
class Spec:
    """A forest: source (SQL of a table), key that numbers its rows, outcome, features with kinds, and parameters."""

    source: str
    key: str
    outcome: str
    features: dict[str, str]
    family: str = "classification"
    classes: list[str] = field(default_factory=list)
    n_trees: int = 1
    depth: int = 1
    mtry: int | None = None
    criterion: str = "gini"
    seed: int = 42
    replace: bool = True
    frac: float = 1.0
    splitter: str = "best"
    weights: str | None = None
    balanced: bool = False
    min_leaf: int = 1

    @property
    def is_class(self) -> bool:
        return self.family == "classification"

    @property
    def slots(self) -> list[str]:
        return [f"s{i}" for i in range(len(self.classes) if self.is_class else 3)]

    def kwargs(self) -> dict:
        """The same for fit_classifier or fit_regressor."""
        out = dict(n_trees=self.n_trees, max_depth=self.depth, mtry=self.mtry, seed=self.seed, replace_sample=self.replace, sample_frac=self.frac, splitter=self.splitter, weights_col=self.weights, criterion=self.criterion if self.is_class else "mse", min_samples_leaf=self.min_leaf, order_by=[self.key])
        return out | ({"class_weight": "balanced"} if self.balanced else {})


def weight(s: list[str], p: Spec) -> str:
    return "(" + " + ".join(s) + ")" if p.is_class else s[0]


def score(s: list[str], p: Spec) -> str:
    if not p.is_class:
        return f"({s[1]} * {s[1]} / nullif({s[0]}, 0))"
    w = weight(s, p)
    if p.criterion == "gini":
        return "((" + " + ".join(f"{x} * {x}" for x in s) + f") / nullif({w}, 0))"
    return "(" + " + ".join(f"CASE WHEN {x} > 0 THEN {x} * log2({x} / {w}) ELSE 0 END" for x in s) + ")"


def impurity(s: list[str], p: Spec) -> str:
    if not p.is_class:
        return f"greatest({s[2]} / {s[0]} - ({s[1]} / {s[0]}) * ({s[1]} / {s[0]}), 0.0)"
    w = weight(s, p)
    if p.criterion == "gini":
        return "(1.0 - (" + " + ".join(f"({x} / {w}) * ({x} / {w})" for x in s) + "))"
    return "(0.0 - (" + " + ".join(f"CASE WHEN {x} > 0 THEN {x} / {w} * log2({x} / {w}) ELSE 0 END" for x in s) + "))"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def draw(*parts: str) -> str:
    return "md5_number(" + " || ':' || ".join(f"({x})::VARCHAR" for x in parts) + ")"


def rows_sql(p: Spec) -> list[str]:
    """r: i, y, w0 and the features of each training row; b: the bags."""
    y = f"CAST({p.outcome} AS VARCHAR)" if p.is_class else f"CAST({p.outcome} AS DOUBLE)"
    w = f"CAST({p.weights} AS DOUBLE)" if p.weights else "1.0::DOUBLE"
    cells = ", ".join(f"CAST({f} AS {'DOUBLE' if k == 'num' else 'VARCHAR'}) AS {f}" for f, k in p.features.items())
    out = [f"r0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {p.key}) AS i, {y} AS y, {w} AS w0, {cells} FROM ({p.source}))"]
    centre = "y" if p.is_class else "y - (SELECT round(avg(y)) FROM r0) AS y"
    bal = "w0 * (SELECT count(*) FROM r0) / ((SELECT count(DISTINCT y) FROM r0) * count(*) OVER (PARTITION BY y))" if p.balanced else "w0"
    out.append(f"r AS MATERIALIZED (SELECT i, {centre}, {bal} AS w0, {', '.join(p.features)} FROM r0)")
    n, trees = "(SELECT count(*) FROM r0)", f"range(1, {p.n_trees + 1}) t(tree)"
    m = f"greatest(1, ceil({p.frac} * {n}))::BIGINT"
    if p.replace:
        d = draw(q(str(p.seed)), "tree", "k")
        out.append(f"b AS MATERIALIZED (SELECT tree, i, count(*) AS c FROM (SELECT tree, ({d} % {n}::UHUGEINT)::BIGINT + 1 AS i FROM {trees}, range(1, {m} + 1) g(k)) GROUP BY ALL)")
    else:
        d = draw(q(str(p.seed)), "tree", "i")
        out.append(f"b AS MATERIALIZED (SELECT tree, i, 1 AS c FROM (SELECT tree, i, row_number() OVER (PARTITION BY tree ORDER BY {d}) AS rk FROM {trees}, r) WHERE rk <= {m})")
    return out


def model_sql(p: Spec) -> list[str]:
    """CTEs that end in model: tree, node, depth, is_leaf, feature, kind, thr, cl, cr, ul, gain, n, wn, imp and the slots."""
    s = p.slots
    one = (lambda k: f"CASE WHEN y = {q(p.classes[k])} THEN w ELSE 0 END") if p.is_class else (lambda k: ("w", "w * y", "w * y * y")[k])
    out = rows_sql(p)
    out.append("f0 AS MATERIALIZED (SELECT b.tree, 1::BIGINT AS node, b.i, b.c * r.w0 AS w, r.y FROM b JOIN r USING (i))")
    parts = []
    left, right = [f"l{k}" for k in range(len(s))], [f"(x.s{k} - l{k})" for k in range(len(s))]
    mtry = p.mtry or (max(1, int(len(p.features) ** 0.5)) if p.is_class else len(p.features))
    for d in range(p.depth + 1):
        sums = ", ".join(f"sum({one(k)})::DOUBLE AS {c}" for k, c in enumerate(s))
        out.append(f"n{d} AS MATERIALIZED (SELECT *, {weight(s, p)} AS wn, {impurity(s, p)} AS imp, {score(s, p)} AS qn FROM (SELECT tree, node, count(*) AS n, {sums} FROM f{d} GROUP BY ALL))")
        leaf = lambda w, d=d: f"SELECT tree, node, {d} AS depth, true AS is_leaf, NULL::VARCHAR AS feature, NULL::VARCHAR AS kind, NULL::DOUBLE AS thr, NULL::VARCHAR[] AS cl, NULL::VARCHAR[] AS cr, NULL::BOOLEAN AS ul, NULL::DOUBLE AS gain, n, wn, imp, {', '.join(s)} FROM n{d} {w}"
        if d == p.depth:
            parts.append(leaf(""))
            break
        cells = " UNION ALL ".join(
            f"SELECT f.tree, f.node, {q(c)} AS col, {q(k)} AS kind, {f'r.{c}' if k == 'num' else 'NULL::DOUBLE'} AS v, {f'r.{c}' if k == 'cat' else 'NULL::VARCHAR'} AS lv, f.w, f.y FROM f{d} f JOIN r USING (i) JOIN n{d} x ON x.tree = f.tree AND x.node = f.node WHERE x.n >= 2 AND x.imp > {EPS}"
            for c, k in p.features.items()
        )
        out.append(f"c{d} AS MATERIALIZED ({cells})")
        lot = draw(q(str(p.seed)), "tree", "node", "col")
        out.append(f"t{d} AS MATERIALIZED (SELECT tree, node, col, lo, hi FROM (SELECT tree, node, col, min(v) AS lo, max(v) AS hi, row_number() OVER (PARTITION BY tree, node ORDER BY {lot}) AS rk FROM c{d} GROUP BY tree, node, col HAVING min(v) < max(v) OR min(lv) < max(lv)) WHERE rk <= {mtry})")
        if p.splitter == "best":
            out.append(f"k{d} AS MATERIALIZED (SELECT tree, node, col, kind, v, lv, count(*) AS bn, {', '.join(f'sum({one(k)})::DOUBLE AS {c}' for k, c in enumerate(s))} FROM c{d} JOIN t{d} USING (tree, node, col) GROUP BY tree, node, col, kind, v, lv)")
            orders = [("num", 0, "v")] + ([("cat", k + 1, f"{c} / {weight(s, p)}") for k, c in enumerate(s)] if p.is_class else [("cat", 1, "s1 / s0")])
            out.append(f"o{d} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT *, {o} AS ord, {e} AS skey FROM k{d} WHERE kind = {q(kind)}" for kind, o, e in orders) + ")")
            cum = ", ".join(f"sum({c}) OVER w AS l{k}" for k, c in enumerate(s))
            out.append(f"p{d} AS MATERIALIZED (SELECT tree, node, col, kind, ord, skey, lv, sum(bn) OVER w AS nl, lead(skey) OVER w AS nx, {cum} FROM o{d} WINDOW w AS (PARTITION BY tree, node, col, ord ORDER BY skey, lv ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")
            order = "gain DESC, col, ord, skey, lv"
            pick = "col, kind, ord, skey, lv, nx, CASE WHEN kind = 'num' THEN CASE WHEN (skey + nx) / 2 < nx THEN (skey + nx) / 2 ELSE skey END END AS thr"
            valid = "nx IS NOT NULL AND "
        else:
            u = f"(({draw(q(f'{p.seed}:RT'), 'tree', 'node', 'col')} % 9007199254740992::UHUGEINT)::DOUBLE / 9007199254740992.0)"
            coin = f"({draw(q(f'{p.seed}:RC'), 'tree', 'node', 'col', 'lv')} % 2::UHUGEINT) = 0"
            out.append(f"k{d} AS MATERIALIZED (SELECT *, CASE WHEN kind = 'num' THEN v <= thr ELSE {coin} END AS goes FROM (SELECT c.*, t.lo + {u.replace('tree', 'c.tree').replace('node', 'c.node').replace('col', 'c.col')} * (t.hi - t.lo) AS thr FROM c{d} c JOIN t{d} t USING (tree, node, col)))")
            out.append(f"p{d} AS MATERIALIZED (SELECT tree, node, col, kind, max(thr) AS thr, count(*) FILTER (goes) AS nl, {', '.join(f'coalesce(sum({one(k)}) FILTER (goes), 0)::DOUBLE AS l{k}' for k in range(len(s)))} FROM k{d} GROUP BY tree, node, col, kind)")
            order, pick, valid = "gain DESC, col", "col, kind, thr", ""
        gain = f"{score(left, p)} + {score(right, p)} - x.qn"
        out.append(f"g{d} AS MATERIALIZED (SELECT * FROM (SELECT p.tree, p.node, {pick}, {gain} AS gain, {weight(left, p)} AS wl, x.wn, row_number() OVER (PARTITION BY p.tree, p.node ORDER BY {order}) AS rk FROM p{d} p JOIN n{d} x USING (tree, node) WHERE {valid}nl >= {p.min_leaf} AND x.n - nl >= {p.min_leaf} AND ({gain}) IS NOT NULL AND ({gain}) / (SELECT wn FROM n0 z WHERE z.tree = p.tree) + {EPS} >= 0) WHERE rk = 1)")
        if p.splitter == "best":
            sides = f"SELECT g.tree, g.node, list(o.lv ORDER BY o.lv) FILTER (o.skey < g.skey OR (o.skey = g.skey AND o.lv <= g.lv)) AS cl, list(o.lv ORDER BY o.lv) FILTER (o.skey > g.skey OR (o.skey = g.skey AND o.lv > g.lv)) AS cr FROM g{d} g JOIN o{d} o USING (tree, node, col, ord) WHERE g.kind = 'cat' GROUP BY ALL"
        else:
            sides = f"SELECT g.tree, g.node, list(DISTINCT k.lv ORDER BY k.lv) FILTER (k.goes) AS cl, list(DISTINCT k.lv ORDER BY k.lv) FILTER (NOT k.goes) AS cr FROM g{d} g JOIN k{d} k USING (tree, node, col) WHERE g.kind = 'cat' GROUP BY ALL"
        out.append(f"m{d} AS MATERIALIZED (SELECT g.tree, g.node, {d} AS depth, false AS is_leaf, g.col AS feature, g.kind, g.thr, z.cl, z.cr, g.wl >= g.wn - g.wl AS ul, g.gain, x.n, x.wn, x.imp, {', '.join(f'x.{c}' for c in s)} FROM g{d} g JOIN n{d} x USING (tree, node) LEFT JOIN ({sides}) z USING (tree, node))")
        parts += [f"SELECT * FROM m{d}", leaf(f"WHERE (tree, node) NOT IN (SELECT (tree, node) FROM m{d})")]
        out.append(f"f{d + 1} AS MATERIALIZED (SELECT f.tree, 2 * f.node + CASE WHEN {side_sql(p, 'm', 'r')} THEN 0 ELSE 1 END AS node, f.i, f.w, f.y FROM f{d} f JOIN r USING (i) JOIN m{d} m ON m.tree = f.tree AND m.node = f.node)")
    out.append("model AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")")
    return out


def side_sql(p: Spec, m: str, r: str) -> str:
    """Whether a row r goes left at a node m; null where it lacks the feature."""
    nums = " ".join(f"WHEN {q(f)} THEN {r}.{f}" for f, k in p.features.items() if k == "num")
    cats = " ".join(f"WHEN {q(f)} THEN {r}.{f}" for f, k in p.features.items() if k == "cat")
    v = f"CASE {m}.feature {nums} END" if nums else "NULL::DOUBLE"
    lv = f"CASE {m}.feature {cats} END" if cats else "NULL::VARCHAR"
    return f"CASE WHEN {m}.kind = 'num' THEN {v} <= {m}.thr WHEN {lv} IS NULL THEN NULL WHEN list_contains({m}.cl, {lv}) THEN true WHEN list_contains({m}.cr, {lv}) THEN false ELSE {m}.ul END"


def walk_sql(p: Spec, rows: str, n_trees: int | None = None, pairs: str | None = None) -> list[str]:
    """CTEs that end in landed: id, tree, node, the leaf's slots and value, of rows (SQL with id and the features)."""
    trees = n_trees or p.n_trees
    start = pairs or f"SELECT id, tree FROM q0, range(1, {trees + 1}) t(tree)"
    out = [f"q0 AS MATERIALIZED ({rows})", f"w0 AS MATERIALIZED (SELECT id, tree, 1::BIGINT AS node FROM ({start}))"]
    for d in range(p.depth):
        out.append(f"w{d + 1} AS MATERIALIZED (SELECT * FROM (SELECT w.id, w.tree, CASE WHEN m.node IS NULL THEN w.node ELSE 2 * w.node + CASE WHEN {side_sql(p, 'm', 'q')} THEN 0 WHEN NOT ({side_sql(p, 'm', 'q')}) THEN 1 END END AS node FROM w{d} w JOIN q0 q ON q.id = w.id LEFT JOIN model m ON m.tree = w.tree AND m.node = w.node AND NOT m.is_leaf) WHERE node IS NOT NULL)")
    value = "" if p.is_class else ", m.s1 / m.s0 + (SELECT round(avg(y)) FROM r0) AS value"
    shares = ", " + ", ".join(f"m.{c} / m.wn AS p{k}" for k, c in enumerate(p.slots)) if p.is_class else ""
    out.append(f"landed AS MATERIALIZED (SELECT w.id, w.tree, w.node{value}{shares} FROM w{p.depth} w JOIN model m ON m.tree = w.tree AND m.node = w.node AND m.is_leaf)")
    return out


def winner(p: Spec, cols: list[str]) -> str:
    best = "greatest(" + ", ".join(cols) + ")"
    return "CASE " + " ".join(f"WHEN {c} = {best} THEN {q(x)}" for c, x in zip(cols, p.classes, strict=True)) + " END"


def select(ctes: list[str], final: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + final
