"""SQL of the queries' results, for a second engine. Matrix steps are unrolled into common table expressions."""

from __future__ import annotations

from collections.abc import Sequence

from sparknorm.functions.contract import BLOCKS, FEATURES

AT = {f: i + 1 for i, f in enumerate(FEATURES)}  # place in the vector, from 1

SUBJECTS = "subjects AS (SELECT vec_id AS participant_id, label AS grp, CAST(embedding[55] AS DOUBLE) AS age, " + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS x{i}" for i in range(1, 55)) + " FROM embeddings)"


def residuals(name: str, cols: Sequence[int], where: str = "grp = 0") -> list[str]:
    """CTEs c_<name> (coefficients of the reference) and r_<name> (all rows' residuals r1 .. rp)."""
    coef = ", ".join(f"regr_slope(x{c}, age) AS b{c}, regr_intercept(x{c}, age) AS a{c}" for c in cols)
    res = ", ".join(f"x{c} - (a{c} + b{c} * age) AS r{i}" for i, c in enumerate(cols, 1))
    return [f"c_{name} AS (SELECT {coef} FROM subjects WHERE {where})", f"r_{name} AS (SELECT participant_id, grp, age, {res} FROM subjects, c_{name})"]


def covariance(name: str, p: int, lam: str, where: str = "grp = 0") -> list[str]:
    raw = ", ".join(f"covar_samp(r{i}, r{j}) AS v_{i}_{j}" for i in range(1, p + 1) for j in range(1, i + 1))
    trace = " + ".join(f"v_{i}_{i}" for i in range(1, p + 1))
    reg = ", ".join(f"(1 - {lam}) * v_{i}_{j}" + (f" + {lam} * ({trace}) / {p}" if i == j else "") + f" AS s_{i}_{j}" for i in range(1, p + 1) for j in range(1, i + 1))
    return [f"v_{name} AS (SELECT {raw} FROM r_{name} WHERE {where})", f"s_{name} AS (SELECT {reg} FROM v_{name})"]


def cholesky(name: str, p: int, source: str, keep: str = "") -> list[str]:
    """CTEs of the factor's columns, the last one k_<name>."""
    out, last = [], source
    for j in range(1, p + 1):
        done = "".join(f" - l_{j}_{k} * l_{j}_{k}" for k in range(1, j))
        out.append(f"k_{name}_{j}a AS (SELECT *, sqrt(s_{j}_{j}{done}) AS l_{j}_{j} FROM {last})")
        rest = "".join(f", (s_{i}_{j}" + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(1, j)) + f") / l_{j}_{j} AS l_{i}_{j}" for i in range(j + 1, p + 1))
        last = f"k_{name}_{j}"
        out.append(f"{last} AS (SELECT *{rest} FROM k_{name}_{j}a)")
    return [*out, f"k_{name} AS (SELECT {keep}" + ", ".join(f"l_{i}_{j}" for i in range(1, p + 1) for j in range(1, i + 1)) + f" FROM {last})"]


def distance(name: str, p: int, joined: str, ids: str = "participant_id") -> list[str]:
    """Forward substitution: d_<name> (ids, d) from rows that have residuals and the factor."""
    out, last = [], joined
    for i in range(1, p + 1):
        out.append(f"y_{name}_{i} AS (SELECT *, (r{i}" + "".join(f" - l_{i}_{k} * y{k}" for k in range(1, i)) + f") / l_{i}_{i} AS y{i} FROM {last})")
        last = f"y_{name}_{i}"
    return [*out, f"d_{name} AS (SELECT {ids}, sqrt(" + " + ".join(f"y{i} * y{i}" for i in range(1, p + 1)) + f") AS d FROM {last})"]


def block(name: str, lam: str = "0.1") -> list[str]:
    cols = [AT[f] for f in BLOCKS[name]]
    p = len(cols)
    return [*residuals(name, cols), *covariance(name, p, lam), *cholesky(name, p, f"s_{name}"), f"j_{name} AS (SELECT * FROM r_{name}, k_{name})", *distance(name, p, f"j_{name}")]


def scored(names: Sequence[str] = tuple(BLOCKS)) -> str:
    """WITH … up to a CTE ``scored`` of ids, groups, distances and the composite."""
    parts = [SUBJECTS, *(c for n in names for c in block(n))]
    mean = " + ".join(f"d_{n}.d" for n in names)
    joins = " ".join(f"JOIN d_{n} USING (participant_id)" for n in names)
    parts.append(f"scored AS (SELECT s.participant_id, s.grp, s.age, " + ", ".join(f"d_{n}.d AS D_{n}" for n in names) + f", ({mean}) / {len(names)} AS composite FROM subjects s {joins})")
    return "WITH " + ", ".join(parts) + " "


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def listed(columns: dict[str, list[str]], source: str) -> str:
    """One SELECT that gives a row for each place of the lists of expressions, so that a wide result takes one scan."""
    return "SELECT " + ", ".join(f"unnest([{', '.join(v)}]) AS {k}" for k, v in columns.items()) + f" FROM {source}"


def quoted(names: Sequence[str]) -> list[str]:
    return [f"'{n}'" for n in names]


def leave_one_out(lam: str = "0.1") -> str:
    """WITH … up to CTEs d_<block> of the distances of reference rows from the models of all others."""
    parts = [SUBJECTS, "refs AS (SELECT * FROM subjects WHERE grp = 0)"]
    for name, features in BLOCKS.items():
        cols = [AT[f] for f in features]
        p = range(1, len(cols) + 1)
        coef = ", ".join(f"regr_slope(j.x{c}, j.age) AS b{i}, regr_intercept(j.x{c}, j.age) AS a{i}" for i, c in enumerate(cols, 1))
        res = ", ".join(f"j.x{c} - (c.a{i} + c.b{i} * j.age) AS r{i}" for i, c in enumerate(cols, 1))
        raw = ", ".join(f"covar_samp(r{i}, r{j}) AS v_{i}_{j}" for i in p for j in range(1, i + 1))
        trace = " + ".join(f"v_{i}_{i}" for i in p)
        reg = ", ".join(f"(1 - {lam}) * v_{i}_{j}" + (f" + {lam} * ({trace}) / {len(cols)}" if i == j else "") + f" AS s_{i}_{j}" for i in p for j in range(1, i + 1))
        parts += [
            f"c_{name} AS (SELECT i.participant_id AS fold, {coef} FROM refs i JOIN refs j ON i.participant_id <> j.participant_id GROUP BY 1)",
            f"rr_{name} AS (SELECT c.fold, j.participant_id, {res} FROM c_{name} c CROSS JOIN refs j)",
            f"vv_{name} AS (SELECT fold, {raw} FROM rr_{name} WHERE participant_id <> fold GROUP BY fold)",
            f"ss_{name} AS (SELECT fold, {reg} FROM vv_{name})",
            *cholesky(name, len(cols), f"ss_{name}", "fold, "),
            f"jj_{name} AS (SELECT * FROM rr_{name} JOIN k_{name} USING (fold) WHERE participant_id = fold)",
            *distance(name, len(cols), f"jj_{name}"),
        ]
    return "WITH " + ", ".join(parts)
