"""SQL of ridge regression on spline features: normal equations by sums, solved by elimination in a recursive query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def basis(place: str, j: int) -> str:
    d = f"abs({place} + {1 - j})"
    return (
        f"CASE WHEN {d} < 1 THEN 2.0::DOUBLE / 3 - pow({d}, 2) + pow({d}, 3) / 2 WHEN {d} < 2 THEN pow(2 - {d}, 3) / 6 ELSE 0 END"
    )


def ridge_steps(
    members: str, spline: Sequence[str], numeric: Sequence[str], label: str, alpha: float = 2.0, prefix: str = "", knots: int = 6
) -> Mapping[str, str]:
    """Steps up to ``<prefix>scored``: the rows of ``members`` with ``prediction`` and, per feature, ``add_<feature>``.

    ``members`` has a row per row and fit: the fit's number ``s``, whether the row trains it (``train``), the features and the label.
    """
    p, features = prefix, [*spline, *numeric]
    limits = ", ".join(
        f'median("{c}") FILTER (train) AS "m_{c}", min("{c}") FILTER (train) AS "lo_{c}", max("{c}") FILTER (train) AS "hi_{c}"' for c in features
    )
    filled = ", ".join(f'coalesce("{c}", "m_{c}", 0)::DOUBLE AS "{c}_x"' for c in features)
    places = ", ".join(
        f'CASE WHEN "hi_{c}" > "lo_{c}" THEN (greatest(least("{c}_x", "hi_{c}"), "lo_{c}") - "lo_{c}") * {knots - 1}::DOUBLE / ("hi_{c}" - "lo_{c}") ELSE 0 END AS "{c}_p"'
        for c in spline
    )
    columns = [basis(f'"{c}_p"', j) for c in spline for j in range(knots + 1)] + [f'"{c}_x"' for c in numeric]
    w = len(columns)
    ends = [*((knots + 1) * (i + 1) for i in range(len(spline))), *((knots + 1) * len(spline) + i + 1 for i in range(len(numeric)))]
    # What each feature adds, up to a constant.
    adds = ", ".join(
        f'list_sum(list_transform(range({a + 1}, {b + 1}), lambda i: w.w[i] * xs[i])) AS "add_{c}"' for c, a, b in zip(features, [0, *ends], ends)
    )
    names = ["x0", *[f"x{i + 1}" for i in range(w)], "_label"]
    products = "[" + ", ".join(
        "[" + ", ".join(f"sum({a} * {b})" if names.index(a) <= names.index(b) else f"sum({b} * {a})" for b in names) + "]" for a in names
    ) + "]"
    return {
        f"{p}limits": f"SELECT s, {limits} FROM {members} GROUP BY s",
        f"{p}filled": f'SELECT r.*, "{label}"::DOUBLE AS _label, {filled}, l.* EXCLUDE (s) FROM {members} r JOIN {p}limits l ON r.s = l.s',
        f"{p}placed": f"SELECT *{', ' + places if places else ''} FROM {p}filled",
        f"{p}design": f"SELECT *, 1.0::DOUBLE AS x0, " + ", ".join(f"{e} AS x{i + 1}" for i, e in enumerate(columns)) + f" FROM {p}placed",
        f"{p}sums": f"SELECT s, count(*)::DOUBLE AS n, {products} AS g FROM {p}design WHERE train AND _label IS NOT NULL GROUP BY s",
        f"{p}scale": f"SELECT *, list_transform(range(2, {w + 2}), lambda i: CASE WHEN g[i][i] - g[1][i] * g[1][i] / n <= 1e-13 * g[i][i] THEN 1.0::DOUBLE "
        f"ELSE sqrt((g[i][i] - g[1][i] * g[1][i] / n) / n) END) AS sc FROM {p}sums",
        f"{p}system": f"SELECT s, n, g, sc, list_transform(range(2, {w + 2}), lambda i: list_append(list_transform(range(2, {w + 2}), lambda j: "
        f"(g[i][j] - g[1][i] * g[1][j] / n) / (sc[i - 1] * sc[j - 1]) + CASE WHEN i = j THEN {alpha}::DOUBLE ELSE 0 END), "
        f"(g[i][{w + 2}] - g[1][i] * g[1][{w + 2}] / n) / sc[i - 1])) AS a FROM {p}scale",
        f"{p}solving": f"SELECT s, 1 AS k, a FROM {p}system UNION ALL SELECT s, k + 1, list_transform(a, lambda r, i: CASE WHEN i = k "
        f"THEN list_transform(r, lambda v: v / a[k][k]) ELSE list_transform(r, lambda v, j: v - r[k] * a[k][j] / a[k][k]) END) FROM {p}solving WHERE k <= {w}",
        f"{p}weights": f"SELECT s, n, g, list_transform(range(1, {w + 1}), lambda i: z.a[i][{w + 1}] / sc[i]) AS w FROM {p}system y JOIN {p}solving z USING (s) WHERE z.k = {w + 1}",
        f"{p}scored": f"SELECT d.*, {adds}, w.g[1][{w + 2}] / w.n - list_sum(list_transform(range(1, {w + 1}), lambda i: w.w[i] * w.g[1][i + 1] / w.n)) "
        f"+ {' + '.join(chr(34) + 'add_' + c + chr(34) for c in features)} AS prediction "
        f"FROM (SELECT *, [{', '.join(names[1:-1])}] AS xs FROM {p}design) d JOIN {p}weights w ON d.s = w.s",
    }
