"""SQL that grows the first trees of the candidates anew, from the vectors alone.

The models' own definition in SQL: the split, bins, fixed-point sums, cuts, growth level by level in a
recursive query, and leaf values.  Nothing of the fitted models is read, so equal scores mean that
the fit grew the same trees.  The cap on leaves isn't reached at the compared scale (20 rows a leaf).
"""

from __future__ import annotations

import math

from hazardloom.operators.trees import BINS, CELLS, DRAWS, FIXED, LEAST_GAIN, PRIME, TreeSpec

K = 5
VECTORS = "SELECT vec_id, embedding, (label % 5)::INT AS cls FROM embeddings"
VECTOR_CELLS = "SELECT vec_id, is_test, (i - 1)::INT AS f, embedding[i]::DOUBLE AS v FROM dealt, range(1, 65) r(i)"
ROWS = (
    "vecs AS ({vectors}), "
    "dealt AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5('42:' || vec_id)) "
    "<= floor(count(*) OVER (PARTITION BY cls) * 0.2e0 + 0.5e0) AS is_test FROM vecs), "
    "raw AS ({cells}), "
    "lims AS (SELECT f, min(v) AS lo, max(v) AS hi FROM raw WHERE NOT is_test GROUP BY f), "
    f"placed AS (SELECT vec_id, f, is_test, greatest(0, least({CELLS - 1}, CASE WHEN hi > lo THEN floor((v - lo) * {CELLS}e0 / (hi - lo)) ELSE 0 END))::INT AS cell "
    "FROM raw JOIN lims USING (f)), "
    f"binned AS MATERIALIZED (SELECT p.vec_id, p.f, (before * {BINS} // (SELECT count(*) FROM dealt WHERE NOT is_test))::INT AS bin FROM placed p "
    "JOIN (SELECT f, cell, sum(sum((NOT is_test)::INT)) OVER (PARTITION BY f ORDER BY cell) - sum((NOT is_test)::INT) AS before FROM placed GROUP BY f, cell) c "
    "ON c.f = p.f AND c.cell = p.cell), "
    "sizes AS (SELECT cls, count(*) AS nc FROM dealt WHERE NOT is_test GROUP BY cls), "
    "trained AS MATERIALIZED (SELECT p.*, {weight} AS balanced FROM dealt p LEFT JOIN sizes s ON s.cls = p.cls)"
)
BALANCED = "(SELECT sum(nc) FROM sizes)::DOUBLE / ((SELECT count(*) FROM sizes)::DOUBLE * nc)"


def _hex(text: str, first: int) -> str:
    return f"('0x' || substr(md5({text}), {first}, 8))::BIGINT"


def _grown(name: str, spec: TreeSpec, measures: str, trees: int, measured: str, worth, picked: str, depth: int) -> str:
    """A recursive query ``name`` (l, t, vec_id, node) and ``{name}_leaf`` (t, vec_id, node)."""
    n = [f"m{i}" for i in range(measures)]
    sums = ", ".join(f"sum({m}) AS {m}" for m in n)
    left = ", ".join(f"sum({m}) OVER (PARTITION BY t, node, f ORDER BY bin) AS l{m}" for m in n)
    total = ", ".join(f"sum({m}) OVER (PARTITION BY t, node, f) AS t{m}" for m in n)
    sides = [f"({worth([f'{side}{m}' for m in n])})" for side in ("l", "r", "t")]
    right = ", ".join(f"t{m} - l{m} AS r{m}" for m in n)
    last = n[-1]
    allowed = f"l{last} >= {max(1, spec.min_rows)} AND r{last} >= {max(1, spec.min_rows)} AND t{last} >= {max(2 * spec.min_rows, spec.min_split_rows)}"
    if spec.kind == "boosted":
        least = round(spec.min_hessian * FIXED)
        allowed += f" AND lm1 >= {least} AND rm1 >= {least}"
    return (
        f"{name} AS (SELECT 0 AS l, t, vec_id, 1::BIGINT AS node FROM dealt, range({trees}) r(t) UNION ALL SELECT * FROM ("
        f"WITH here AS (SELECT DISTINCT t, node FROM {name}), pick AS ({picked}), "
        f"h AS (SELECT w.t, w.node, b.f, b.bin, {sums} FROM {name} w JOIN {measured} g ON g.t = w.t AND g.vec_id = w.vec_id "
        f"JOIN pick k ON k.t = w.t AND k.node = w.node JOIN binned b ON b.vec_id = w.vec_id AND b.f = k.f GROUP BY w.t, w.node, b.f, b.bin), "
        f"c AS (SELECT *, {left}, {total} FROM h), d AS (SELECT *, {right} FROM c), "
        f"s AS (SELECT t, node, f, bin, ({sides[0]} + {sides[1]} - {sides[2]}) / {FIXED}e0 AS gain, "
        f"row_number() OVER (PARTITION BY t, node ORDER BY {sides[0]} + {sides[1]} DESC, f, bin) AS rk FROM d WHERE {allowed}) "
        f"SELECT w.l + 1, w.t, w.vec_id, 2 * w.node + (b.bin > s.bin)::INT FROM {name} w JOIN s ON s.t = w.t AND s.node = w.node AND rk = 1 AND gain > {LEAST_GAIN} "
        f"JOIN binned b ON b.vec_id = w.vec_id AND b.f = s.f WHERE w.l < {depth})), "
        f"{name}_leaf AS (SELECT t, vec_id, arg_max(node, l) AS node FROM {name} GROUP BY t, vec_id)"
    )


def boosted_scores(spec: TreeSpec, rounds: int, name: str = "b") -> str:
    """CTEs up to ``{name}_scores`` (vec_id, cls, score): probabilities of all rows after the first rounds."""
    ctes = [f"{name}_z0 AS (SELECT t, vec_id, 0e0 AS z FROM dealt, range({K}) r(t))"]
    f, w = f"{FIXED}e0", "balanced" if spec.balanced else "one"

    def worth(m):
        return f"{m[0]}::DOUBLE * {m[0]}::DOUBLE / ({m[1]}::DOUBLE + {spec.l2 * FIXED}::DOUBLE)"

    for r in range(rounds):
        z, g, tree = f"{name}_z{r}", f"{name}_g{r}", f"{name}_r{r}"
        ctes += [
            f"{z}p AS (SELECT t, vec_id, exp(z - max(z) OVER v) / sum(exp(z - mz)) OVER v AS p FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS mz FROM {z}) WINDOW v AS (PARTITION BY vec_id))",
            f"{g} AS MATERIALIZED (SELECT t, vec_id, round((p - (cls = t)::INT) * {w} * {f})::BIGINT AS m0, round(2e0 * p * (1e0 - p) * {w} * {f})::BIGINT AS m1, 1::BIGINT AS m2 "
            f"FROM {z}p JOIN trained USING (vec_id) WHERE NOT is_test)",
            _grown(tree, spec, 3, K, g, worth, "SELECT t, node, f FROM here, range(64) q(f)", spec.max_depth if spec.max_leaves is None else 60),
            f"{tree}_value AS (SELECT t, node, -(sum(m0) / {f}) / (sum(m1) / {f} + {spec.l2}::DOUBLE) * {spec.rate}::DOUBLE AS value "
            f"FROM {tree}_leaf JOIN {g} USING (t, vec_id) GROUP BY t, node)",
            f"{name}_z{r + 1} AS MATERIALIZED (SELECT t, vec_id, z + value AS z FROM {z} JOIN {tree}_leaf USING (t, vec_id) JOIN {tree}_value USING (t, node))",
        ]
    ctes.append(
        f"{name}_scores AS (SELECT vec_id, t::INT AS cls, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id) AS score FROM {name}_z{rounds})"
    )
    return ", ".join(ctes)


def forest_scores(spec: TreeSpec, trees: int, name: str = "f", d: int = 64) -> str:
    """CTEs up to ``{name}_scores``: mean class shares of the first trees' leaves, over ``d`` features."""
    seed, w = spec.seed, "balanced" if spec.balanced else "one"
    times = " + ".join(f"(u >= {p!r}::DOUBLE)::INT" for p in DRAWS.tolist())
    measures = ", ".join(f"(CASE WHEN cls = {c} THEN round({w} * {FIXED}e0)::BIGINT * k ELSE 0 END)::BIGINT AS m{c}" for c in range(K))

    def worth(m):
        squares = " + ".join(f"{c}::DOUBLE * {c}::DOUBLE" for c in m[:-1])
        return f"({squares}) / ({' + '.join(f'{c}::DOUBLE' for c in m[:-1])})"

    draw = f"(({_hex(key := f'''('{seed}:tree:' || t)''', 1)} % {PRIME - 1} + 1) * ({_hex(f'''('{seed}:row:' || vec_id)''', 1)} % {PRIME}) + {_hex(key, 9)} % {PRIME}) % {PRIME}"
    # Features of a node: the square root of them, with the smallest numbers.
    node = f"('{seed}:tree:' || t || ':node:' || node)"
    numbers = f"SELECT t, node, {_hex(node, 1)} % {PRIME - 1} + 1 AS a, {_hex(node, 9)} % {PRIME} AS b FROM here"
    picked = (
        f"SELECT t, node, f FROM (SELECT t, node, f, row_number() OVER (PARTITION BY t, node ORDER BY (a * (f + 1) + b) % {PRIME}, f) AS place "
        f"FROM ({numbers}), range({d}) q(f)) WHERE place <= {math.isqrt(d)}"
    )
    ctes = [
        f"{name}_g AS MATERIALIZED (SELECT t, vec_id, {measures}, 1::BIGINT AS m{K} FROM (SELECT t, vec_id, cls, {w}, {times} AS k FROM "
        f"(SELECT t, vec_id, cls, {w}, ({draw})::DOUBLE / {PRIME}e0 AS u FROM trained, range({trees}) r(t) WHERE NOT is_test)) WHERE k > 0)",
        _grown(f"{name}_r", spec, K + 1, trees, f"{name}_g", worth, picked, spec.max_depth),
        f"{name}_share AS (SELECT t, node, " + ", ".join(f"sum(m{c})::DOUBLE AS s{c}" for c in range(K)) + f" FROM {name}_r_leaf JOIN {name}_g USING (t, vec_id) GROUP BY t, node)",
        f"{name}_scores AS (SELECT vec_id, c::INT AS cls, avg([s0, s1, s2, s3, s4][c + 1] / (s0 + s1 + s2 + s3 + s4)) AS score "
        f"FROM {name}_r_leaf JOIN {name}_share USING (t, node), range({K}) r(c) GROUP BY vec_id, c)",
    ]
    return ", ".join(ctes)


def _rows(vectors: str, cells: str) -> str:
    return ROWS.replace("{weight}", f"1e0 AS one, {BALANCED}").replace("{vectors}", vectors).replace("{cells}", cells)


def text_scores_sql(head: str, labelled: str, set_cells: str, d: int, spec: TreeSpec, trees: int, body: str) -> str:
    """``body`` over ``t_scores`` (vec_id, cls, score): a forest's first trees on sparse features.

    ``head`` has the expressions that the others use, ``labelled`` gives vec_id and cls, ``set_cells`` entity, feature
    and value.
    """
    cells = (
        f"SELECT x.vec_id, is_test, x.f::INT AS f, coalesce(s.value, 0e0) AS v FROM (SELECT vec_id, is_test, f FROM dealt, range({d}) q(f)) x "
        f"LEFT JOIN ({set_cells}) s ON s.entity = x.vec_id AND s.feature = x.f"
    )
    return f"WITH RECURSIVE {head}, {_rows(labelled, cells)}, {forest_scores(spec, trees, 't', d)} {body}"


def _head(specs: dict[str, tuple[TreeSpec, int]]) -> str:
    """``WITH RECURSIVE`` with the scores of each named model after its first rounds."""
    rows = _rows(VECTORS, VECTOR_CELLS)
    parts = [(boosted_scores if s.kind == "boosted" else forest_scores)(s, n, name) for name, (s, n) in specs.items()]
    return f"WITH RECURSIVE {rows}, " + ", ".join(parts)


def test_scores_sql(spec: TreeSpec, rounds: int, extra: str = "") -> str:
    """Scores of the test part after the first rounds, a row per class."""
    body = f"SELECT vec_id, m_scores.cls, round(score, 9) AS score{extra} FROM m_scores JOIN dealt p USING (vec_id) WHERE is_test"
    return f"{_head({'m': (spec, rounds)})} {body}"


def first_scores_sql(specs: dict[str, TreeSpec], body: str) -> str:
    """``body`` over ``every_score`` (model, vec_id, cls, score), what each candidate's first round says of all rows."""
    named = {f"m{i}": (s, 1) for i, s in enumerate(specs.values())}
    scores = " UNION ALL ".join(f"SELECT '{name}' AS model, vec_id, cls, round(score, 12) AS score FROM m{i}_scores" for i, name in enumerate(specs))
    return f"{_head(named)}, every_score AS MATERIALIZED ({scores}) {body}"


def comparison_sql(specs: dict[str, TreeSpec], metrics) -> str:
    """Metrics of every candidate's first round on the test part."""
    oks = ", ".join(f"true AS {c}_ok" for c in ("accuracy", "recall", "f1", "auc"))
    return first_scores_sql(specs, f"SELECT *, {oks} FROM ({metrics('SELECT * FROM every_score')})")


def margins_sql(spec: TreeSpec) -> str:
    """Margin of the true class of every test row after the first round."""
    body = "SELECT vec_id, cls, 64 AS features, round(z, 9) AS margin FROM m_z1 JOIN dealt p USING (vec_id) WHERE is_test AND t = cls"
    return f"{_head({'m': (spec, 1)})} {body}"
