"""Decision trees of several levels next to SQL that grows the same tree level by level."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortline.catalog.modelling import _COMPLETE, FEATURES, _complete
from cohortline.catalog.registry import query
from cohortline.plans.features import with_label
from cohortline.plans.models import fit_model, importances, tree_rules
from cohortline.session import materialize

DEPTH = 3
IMPURITY = {"gini": "2 * ({p} / {n}) * (1 - {p} / {n})",
            "entropy": "-(CASE WHEN {p} > 0 THEN {p} / {n} * LOG2({p} / {n}) ELSE 0 END + CASE WHEN {p} < {n} THEN (1 - {p} / {n}) * LOG2(1 - {p} / {n}) ELSE 0 END)"}


def grown(criterion: str, depth: int = DEPTH) -> str:
    """CTEs that end in ``nd``, the nodes of the pruned tree, and ``w<depth>``, the way of each row through the unpruned one.

    A split lies halfway between neighbouring values of all rows. Of equal gains the first feature and the lowest split win. A node
    is a leaf at the last level, without a gain, or if both children are leaves of the same class. Node numbers are those of a heap.
    """
    impurity = IMPURITY[criterion].format
    value = "CASE f " + " ".join(f"WHEN '{f}' THEN cf.{f}" for f in FEATURES) + " END"
    long = " UNION ALL ".join(f"SELECT subject_id, {i} AS fi, '{f}' AS f, CAST({f} AS DOUBLE) AS x FROM cf" for i, f in enumerate(FEATURES))
    parts = [_COMPLETE, f"lg AS ({long})", "gv AS (SELECT f, x, LEAD(x) OVER (PARTITION BY f ORDER BY x) AS nx FROM (SELECT DISTINCT f, x FROM lg))",
             "w0 AS (SELECT subject_id, CAST(rbg300 <= 8 AS INT) AS label, 1 AS node FROM cf)"]
    for d in range(depth):
        parts += [
            f"v{d} AS (SELECT node, fi, f, x, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(label) AS DOUBLE) AS p FROM lg JOIN w{d} USING (subject_id) GROUP BY ALL)",
            f"c{d} AS (SELECT node, fi, f, x, SUM(n) OVER u AS nl, SUM(p) OVER u AS pl, SUM(n) OVER a AS nt, SUM(p) OVER a AS pt FROM v{d} "
            "WINDOW u AS (PARTITION BY node, f ORDER BY x), a AS (PARTITION BY node, f))",
            f"g{d} AS (SELECT *, {impurity(n='nt', p='pt')} - nl / nt * ({impurity(n='nl', p='pl')}) "
            f"- (nt - nl) / nt * ({impurity(n='(nt - nl)', p='(pt - pl)')}) AS gain FROM c{d} WHERE nl < nt)",
            f"s{d} AS (SELECT node, fi, f, (x + nx) / 2 AS cut, gain FROM g{d} JOIN gv USING (f, x) WHERE gain > 1e-15 "
            "QUALIFY ROW_NUMBER() OVER (PARTITION BY node ORDER BY ROUND(gain, 13) DESC, fi, x) = 1)",
            f"w{d + 1} AS (SELECT subject_id, w{d}.label, 2 * node + CAST({value} > cut AS INT) AS node FROM w{d} JOIN s{d} USING (node) JOIN cf USING (subject_id))"]
    parts.append("al AS (" + " UNION ALL ".join(
        f"SELECT {d} AS level, node, COUNT(*) AS n, SUM(label) AS p, CAST(2 * SUM(label) > COUNT(*) AS INT) AS cls FROM w{d} GROUP BY node"
        for d in range(depth + 1)) + ")")
    parts.append("sp AS (" + " UNION ALL ".join(f"SELECT * FROM s{d}" for d in range(depth)) + ")")
    parts.append(f"l{depth} AS (SELECT node, cls, TRUE AS leaf FROM al WHERE level = {depth})")
    for d in range(depth - 1, -1, -1):
        parts.append(f"l{d} AS (SELECT al.node, al.cls, sp.node IS NULL OR (a.leaf AND b.leaf AND a.cls = b.cls) AS leaf FROM al "
                     f"LEFT JOIN sp ON sp.node = al.node LEFT JOIN l{d + 1} a ON a.node = 2 * al.node LEFT JOIN l{d + 1} b ON b.node = 2 * al.node + 1 "
                     f"WHERE level = {d})")
    parts.append("lf AS (" + " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(depth + 1)) + ")")
    parts.append("k0 AS (SELECT node, leaf FROM lf WHERE node = 1)")
    for d in range(depth):
        parts.append(f"k{d + 1} AS (SELECT lf.node, lf.leaf FROM k{d} JOIN lf ON lf.node IN (2 * k{d}.node, 2 * k{d}.node + 1) WHERE NOT k{d}.leaf)")
    parts.append("nd AS (SELECT al.*, k.leaf, sp.fi, sp.f, sp.cut, sp.gain FROM (" + " UNION ALL ".join(f"SELECT * FROM k{d}" for d in range(depth + 1))
                 + ") k JOIN al USING (node) LEFT JOIN sp ON sp.node = al.node AND NOT k.leaf)")
    return "WITH " + ",\n".join(parts)


def _in_leaves(depth: int = DEPTH) -> str:
    """Each row with its leaf: of the nodes on its way, the one that is a leaf of the pruned tree."""
    ways = " UNION ALL ".join(f"SELECT subject_id, node FROM w{d}" for d in range(depth + 1))
    return f"SELECT subject_id, CAST(cls AS DOUBLE) AS prediction, ROUND(CAST(p AS DOUBLE) / n, 6) AS probability FROM ({ways}) JOIN nd USING (node) WHERE leaf"


def _fitted(spark, d, criterion):
    rows = materialize(with_label(_complete(spark, d), 8, onset="rbg300"))
    return rows, fit_model("tree", rows, FEATURES, params={"criterion": criterion, "max_depth": DEPTH})


def _applied(spark, d, criterion):
    rows, model = _fitted(spark, d, criterion)
    return model.transform(rows).select("subject_id", "prediction", "probability")


@query("m7_tree_gini_depth3", f"{grown('gini')}\n{_in_leaves()}")
def gini(spark, d):
    return _applied(spark, d, "gini")


@query("m7_tree_entropy_depth3", f"{grown('entropy')}\n{_in_leaves()}")
def entropy(spark, d):
    return _applied(spark, d, "entropy")


@query("m16_tree_importances", f"""{grown('gini')},
im AS (SELECT f, SUM(gain * n) AS s FROM nd WHERE NOT leaf GROUP BY f)
SELECT feature, ROUND(COALESCE(s / (SELECT SUM(s) FROM im), 0), 6) AS importance
FROM (SELECT UNNEST({FEATURES}) AS feature) LEFT JOIN im ON f = feature""")
def tree_importances(spark, d):
    return importances(spark, _fitted(spark, d, "gini")[1])


# the order of lines is that of the keys: a node's If, its left subtree, its Else, its right subtree
_PATH = " || ".join(f"(CASE WHEN level > {d} THEN CASE (node >> (level - {d + 1})) & 1 WHEN 0 THEN 'b' ELSE 'd' END ELSE '' END)" for d in range(DEPTH))


@query("m17_tree_rule_lines", f"""{grown('gini')},
pa AS (SELECT *, {_PATH} AS path, repeat(' ', level + 2) AS pad FROM nd),
li AS (SELECT path || 'a' AS key, pad || 'If (' || f || ' <= ' || CAST(cut AS VARCHAR) || ')' AS rule FROM pa WHERE NOT leaf
  UNION ALL SELECT path || 'c', pad || 'Else (' || f || ' > ' || CAST(cut AS VARCHAR) || ')' FROM pa WHERE NOT leaf
  UNION ALL SELECT path, pad || 'Predict: ' || CAST(CAST(cls AS DOUBLE) AS VARCHAR) FROM pa WHERE leaf)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY key) AS BIGINT) AS line, rule FROM li""")
def rule_lines(spark, d):
    """The rules of the tree without the first line, which names the model."""
    return tree_rules(spark, _fitted(spark, d, "gini")[1]).filter("line > 0").select(F.col("line").cast("long"), "rule")
