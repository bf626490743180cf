"""Ridge regression on spline features by normal equations: many fits in one pass over the rows.

A fit is a number beside a row (``fit`` column); a row that trains several models, as in expanding folds or for several
targets, stands once for each. Medians and ranges of all fits come from one quantile selection. Then every task sums
the products of the rows' features per fit, sums of tasks are added, and the small system of each fit is solved.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, functions as F

from .features import bspline_position_sql
from .quantiles import exact_quantiles

#: Cubic B-splines over one knot interval, as polynomials of the place in it: constant to cubic term of the four that are not zero.
_PIECES = np.array([[1, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]]) / 6.0


@dataclass(frozen=True)
class Design:
    """Features of one fit: ``spline`` columns by cubic B-splines (all but the last), ``numeric`` ones as they are."""

    spline: tuple[str, ...]
    numeric: tuple[str, ...]
    knots: int = 6

    @property
    def features(self) -> tuple[str, ...]:
        return (*self.spline, *self.numeric)


@dataclass(frozen=True)
class Filling:
    """Training numbers of a feature: its median fills gaps, its range carries the knots."""

    median: float
    lo: float
    hi: float


def fillings(rows: DataFrame, features: Sequence[str], fit: str) -> dict[int, dict[str, Filling]]:
    """Per fit and feature; a feature without any value is filled with 0. As many numbers come back as there are fits and features."""
    found = exact_quantiles(rows, features, [0.0, 0.5, 1.0], [fit]).collect()
    return {r[fit]: {c: Filling(q[1] or 0.0, q[0] or 0.0, q[2] or 0.0) if q else Filling(0.0, 0.0, 0.0) for c, q in zip(features, r[1:])} for r in found}


def _columns(block: Mapping[str, np.ndarray], design: Design, fill: Mapping[str, Filling]) -> np.ndarray:
    """1, spline columns, numeric columns less their median, for the rows of ``block``."""
    n = len(next(iter(block.values())))
    out = [np.ones(n)]
    for c in design.spline:
        f, x = fill[c], block[c]
        x = np.clip(np.where(np.isnan(x), f.median, x), f.lo, f.hi)
        place = (x - f.lo) * (design.knots - 1) / (f.hi - f.lo) if f.hi > f.lo else np.zeros(n)
        k = np.minimum(place.astype(int), design.knots - 2)
        values = np.vander(place - k, 4, increasing=True) @ _PIECES.T
        basis = np.zeros((n, design.knots + 2))
        np.put_along_axis(basis, k[:, None] + np.arange(4), values, axis=1)
        out += list(basis[:, :-1].T)
    for c in design.numeric:
        out.append(np.where(np.isnan(block[c]), 0.0, block[c] - fill[c].median))
    return np.column_stack(out)


def normal_sums(
    rows: DataFrame, designs: Mapping[int, Design], fills: Mapping[int, Mapping[str, Filling]], label: str, fit: str
) -> dict[int, np.ndarray]:
    """Per fit the products of all columns of :func:`_columns` and the label, summed over its rows.

    A task gives one array per fit; fits × columns² numbers are shuffled per task and come back once.
    """
    names = list(dict.fromkeys(c for d in designs.values() for c in d.features))
    read = rows.select(F.col(f"`{fit}`").cast("long").alias("fit"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate([*names, label])])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            which, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            values = [np.asarray(v, float) for v in values]
            for i in np.unique(which).tolist():
                here = which == i
                y = values[-1][here]
                x = _columns({c: v[here] for c, v in zip(names, values)}, designs[i], fills[i])
                z = np.column_stack([x, y])
                held[i] = held.get(i, 0.0) + z.T @ z
        if held:
            flat = [held[i].ravel() for i in held]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(flat, pa.list_(pa.float64()))], ["fit", "sums"])

    parts = read.where(F.col(f"x{len(names)}").isNotNull()).mapInArrow(sums, "fit long, sums array<double>")
    total = parts.select("fit", F.posexplode("sums").alias("at", "s")).groupBy("fit", "at").agg(F.sum("s").alias("s"))
    out: dict[int, np.ndarray] = {}
    for r in total.collect():
        design = designs[r["fit"]]
        width = 2 + len(design.spline) * (design.knots + 1) + len(design.numeric)
        out.setdefault(r["fit"], np.zeros(width * width))[r["at"]] = r["s"]
    return {i: s.reshape(int(len(s) ** 0.5), -1) for i, s in out.items()}


def solve(sums: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights on the columns as they are, for a penalty on columns of mean 0 and deviation 1."""
    n, s, sy = sums[0, 0], sums[0, 1:-1], sums[0, -1]
    spread = sums[1:-1, 1:-1] - np.outer(s, s) / n
    scale = np.sqrt(np.maximum(np.diag(spread), 0) / n)
    # What is constant but for rounding is only centred.
    scale[np.diag(spread) <= 1e-13 * np.diag(sums)[1:-1]] = 1.0
    system = spread / np.outer(scale, scale) + alpha * np.eye(len(s))
    if not alpha:
        weights = np.linalg.lstsq(system, (sums[1:-1, -1] - s * sy / n) / scale, rcond=None)[0] / scale
    else:
        weights = np.linalg.solve(system, (sums[1:-1, -1] - s * sy / n) / scale) / scale
    return float(sy / n - s @ weights / n), weights


@dataclass(frozen=True)
class Term:
    """What a feature adds: SQL over its ``place`` among the knots (as ``{p}``), or over its column where there is no place."""

    feature: str
    place: str | None
    value: str


@dataclass(frozen=True)
class Additive:
    """A fitted sum: an intercept and one term per feature, each over the feature's own column only."""

    intercept: float
    terms: tuple[Term, ...]

    def places(self, prefix: str = "_p") -> dict[str, str]:
        """Columns that the other expressions read, with their SQL; apart, so that each is computed once per row."""
        return {f"{prefix}{i}": t.place for i, t in enumerate(self.terms) if t.place}

    def values(self, prefix: str = "_p") -> dict[str, str]:
        """What each feature adds."""
        return {t.feature: t.value.replace("{p}", f"{prefix}{i}") for i, t in enumerate(self.terms)}

    def prediction(self, prefix: str = "_p") -> str:
        return " + ".join([f"{self.intercept!r}D", *self.values(prefix).values()])


def _spline_term(name: str, weights: np.ndarray, fill: Filling, knots: int) -> Term:
    """The weighted splines as one cubic per knot interval."""
    cubic = np.array([np.append(weights, 0.0)[k : k + 4] @ _PIECES for k in range(knots - 1)])
    x = f"coalesce(CAST(`{name}` AS DOUBLE), {fill.median!r}D)"
    place = bspline_position_sql(x, f"{fill.lo!r}D", f"{fill.hi!r}D", knots)
    a, b, c, d = ("element_at(array(" + ", ".join(f"{float(v)!r}D" for v in col) + "), {k} + 1)" for col in cubic.T)
    k = f"least(cast({{p}} as int), {knots - 2})"
    t = f"({{p}} - {k})"
    return Term(name, place, f"({a} + {t} * ({b} + {t} * ({c} + {t} * {d})))".replace("{k}", k))


def fit_additive(
    rows: DataFrame, designs: Mapping[int, Design], label: str, fit: str, alpha: float = 2.0
) -> dict[int, Additive]:
    """A model for each fit that has labelled rows."""
    rows = rows.where(F.col(f"`{label}`").isNotNull())
    fills = fillings(rows, list(dict.fromkeys(c for d in designs.values() for c in d.features)), fit)
    out = {}
    for i, sums in normal_sums(rows, designs, fills, label, fit).items():
        design, fill = designs[i], fills[i]
        intercept, weights = solve(sums, alpha)
        terms, at, width = [], 0, design.knots + 1
        for c in design.spline:
            terms.append(_spline_term(c, weights[at : at + width], fill[c], design.knots))
            at += width
        for c, w in zip(design.numeric, weights[at:]):
            terms.append(Term(c, None, f"coalesce(({float(w)!r}D) * (CAST(`{c}` AS DOUBLE) - ({fill[c].median!r}D)), 0D)"))
        out[i] = Additive(intercept, tuple(terms))
    return out


def pipeline(model: Additive) -> PipelineModel:
    """The model as a pipeline that adds ``prediction`` (and the places ``_p0, _p1, …``) and can be saved."""
    places = "".join(f", {e} AS {n}" for n, e in model.places().items())
    return PipelineModel([SQLTransformer(statement=f"SELECT *, {model.prediction()} AS prediction FROM (SELECT *{places} FROM __THIS__)")])
