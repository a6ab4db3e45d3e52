"""Cox proportional hazards models with Efron ties and strata.

A fit is a loop of Newton steps. Each step is one Spark job over the covariate
rows: every task folds its rows into sums per (model, stratum, day), with NumPy
on Arrow batches, and Spark adds these sums up per day. The driver only sees one
row per (model, stratum, day) - the follow-up horizon bounds their number - and
does the running risk-set sums, the tie correction and the p x p solve. Several
models with the same covariates (one per data stream) share each job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.pvalues import chi_square_tail, normal_two_sided
from cohortwise.functions.ties import efron_sums
from cohortwise.operators.concordance import concordance
from cohortwise.operators.covariance import covariance
from cohortwise.operators.survival import Z_95, ByStratum, Factor, Term, term_names
from cohortwise.sources.durable import durable


_ROWS_OUT = 64


def _exp(x: float) -> float:
    """Infinity where the ratio is beyond a double, as under separation."""
    return math.exp(x) if x < 709.0 else math.inf


@dataclass
class _Layout:
    """Positions of the sums inside one packed vector."""

    width: int

    def __post_init__(self):
        self.upper = np.triu_indices(self.width)
        self.block = 1 + self.width + len(self.upper[0])
        self.size = 2 + self.width + 2 * self.block

    def weighted(self, z: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Sums of the weights, of the weighted columns and of their products, the products as one matrix product."""
        return np.concatenate([[weight.sum()], weight @ z, ((z * weight[:, None]).T @ z)[self.upper]])

    def unpack(self, packed: np.ndarray) -> dict[str, np.ndarray]:
        p, q = self.width, self.block
        risk, tied = packed[:, 2 + p : 2 + p + q], packed[:, 2 + p + q :]
        return {
            "n": packed[:, 0],
            "d": packed[:, 1],
            "sum_x": packed[:, 2 : 2 + p],
            "r0": risk[:, 0],
            "r1": risk[:, 1 : 1 + p],
            "r2": self._square(risk[:, 1 + p :]),
            "t0": tied[:, 0],
            "t1": tied[:, 1 : 1 + p],
            "t2": self._square(tied[:, 1 + p :]),
        }

    def _square(self, packed: np.ndarray) -> np.ndarray:
        full = np.zeros((len(packed), self.width, self.width))
        full[:, self.upper[0], self.upper[1]] = packed
        full[:, self.upper[1], self.upper[0]] = packed
        return full


@dataclass
class _State:
    """Scaling and current coefficients of one model, in standardised units."""

    center: np.ndarray
    scale: np.ndarray
    rows: int
    level_share: np.ndarray
    beta: np.ndarray
    previous: np.ndarray | None = None
    kept: np.ndarray | None = None
    loglik: float = -math.inf
    loglik_null: float | None = None
    converged: bool = False
    steps: int = 0
    sums: dict | None = None
    keys: pd.DataFrame | None = None
    pieces: dict = field(default_factory=dict)


def _fold_partition(states: dict[str, tuple], width: int):
    """Partition function: rows to packed sums per (model, stratum, time); no table of rows by products is built."""
    layout = _Layout(width)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.select(["model", "stratum", "time"]).to_pandas()
            event = batch.column("event").to_numpy(zero_copy_only=False).astype(float)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            for model, index in keys.groupby("model").indices.items():
                center, scale, beta = states[model]
                groups = keys.iloc[index].groupby(["stratum", "time"]).ngroup().to_numpy()
                order = np.argsort(groups, kind="stable")
                index, groups = index[order], groups[order]
                starts = np.flatnonzero(np.r_[True, np.diff(groups) != 0])
                firsts = keys.iloc[index[starts]]
                for at, stratum, time in zip(np.split(index, starts[1:]), firsts["stratum"], firsts["time"]):
                    z = (x[at] - center) / scale
                    weight, died = np.exp(z @ beta), event[at]
                    row = np.concatenate([[len(z), died.sum()], died @ z, layout.weighted(z, weight), layout.weighted(z, weight * died)])
                    key = (model, stratum, int(time))
                    if key in sums:
                        sums[key] += row
                    else:
                        sums[key] = row
        held = list(sums.items())
        for first in range(0, len(held), _ROWS_OUT):
            keys, values = zip(*held[first : first + _ROWS_OUT])
            models, strata, times = zip(*keys)
            offsets = np.arange(0, len(values) * layout.size + 1, layout.size, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(models), pa.array(strata), pa.array(times, pa.int32()), pa.ListArray.from_arrays(offsets, np.concatenate(values))],
                names=["model", "stratum", "time", "packed"],
            )

    return fold


def _sums(rows: DataFrame, states: dict[str, _State], width: int) -> pd.DataFrame:
    """One distributed pass: packed sums per (model, stratum, time) for the given models."""
    frozen = {m: (s.center, s.scale, s.beta) for m, s in states.items()}
    chosen = rows.filter(F.col("model").isin(list(frozen)))
    partial = chosen.mapInArrow(_fold_partition(frozen, width), "model string, stratum string, time int, packed array<double>")
    merged = partial.groupBy("model", "stratum", "time").agg(
        vector_to_array(Summarizer.sum(array_to_vector("packed"))).alias("packed")
    )
    return merged.toArrow().to_pandas()


def _running(values: np.ndarray, strata: np.ndarray) -> np.ndarray:
    """Sums over the risk set: per stratum, this time and all later ones (rows sorted by time)."""
    result = np.empty_like(values)
    for stratum in np.unique(strata):
        at = strata == stratum
        result[at] = np.cumsum(values[at][::-1], axis=0)[::-1]
    return result


def _likelihood(table: pd.DataFrame, beta: np.ndarray, layout: _Layout) -> dict:
    """Log partial likelihood, gradient, information and the pieces per event time."""
    table = table.sort_values(["stratum", "time"], kind="stable").reset_index(drop=True)
    part = layout.unpack(np.stack(table["packed"].to_numpy()))
    strata = table["stratum"].to_numpy()
    r0, r1, r2 = (_running(part[name], strata) for name in ("r0", "r1", "r2"))
    at = np.flatnonzero(part["d"] > 0)
    loglik = float((part["sum_x"] @ beta).sum())
    log, *shares = efron_sums(r0[at], part["t0"][at], np.rint(part["d"][at]))
    loglik -= float(log.sum())
    a0, a1, b0, b1, b2 = (share[:, None] for share in shares)
    risk, tied = r1[at], part["t1"][at]
    means = risk * a0 - tied * a1
    outer = lambda x, y: x[:, :, None] * y[:, None, :]
    cross = outer(risk, tied * b1)
    spreads = (
        r2[at] * a0[:, :, None] - part["t2"][at] * a1[:, :, None]
        - outer(risk, risk * b0) + cross + cross.transpose(0, 2, 1) - outer(tied, tied * b2)
    )
    return {
        "loglik": float(loglik),
        "gradient": part["sum_x"].sum(axis=0) - means.sum(axis=0),
        "information": spreads.sum(axis=0),
        "times": table.loc[at, ["stratum", "time"]].reset_index(drop=True),
        "deaths": part["d"][at],
        "residual_sums": part["sum_x"][at] - means,
        "means": means / part["d"][at][:, None],
        "spreads": spreads,
        "all_times": table["time"].to_numpy(),
        "all_n": part["n"],
        "all_d": part["d"],
        "n_event": int(round(part["d"].sum())),
    }


def _independent(information: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Columns that are not linear combinations of earlier ones, by an in-order Cholesky sweep."""
    work = information.copy()
    start = np.diag(information).copy()
    kept = np.zeros(len(work), dtype=bool)
    for j in range(len(work)):
        if start[j] > tolerance and work[j, j] > tolerance * start[j]:
            kept[j] = True
            work[j + 1 :, j + 1 :] -= np.outer(work[j + 1 :, j], work[j, j + 1 :]) / work[j, j]
        work[j:, j] = 0.0
        work[j, j:] = 0.0
    return kept


@dataclass
class CoxModel:
    """A fitted model in the units of the covariates; dropped columns have null coefficients."""

    model: str
    names: list[str]
    coef: np.ndarray
    kept: np.ndarray
    variance: np.ndarray
    rows: int
    events: int
    loglik_null: float
    loglik: float
    converged: bool
    steps: int
    shares: np.ndarray
    pieces: dict

    def standard_errors(self) -> np.ndarray:
        return np.sqrt(np.diag(self.variance))

    def aic(self) -> float:
        return 2.0 * self.kept.sum() - 2.0 * self.loglik


class CoxFit:
    """Models fitted together and the rows they were fitted on."""

    def __init__(self, rows: DataFrame, models: list[CoxModel], terms: Sequence[Term]):
        self.rows = rows
        self.models = models
        self.terms = list(terms)
        self.spark = rows.sparkSession

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def coefficients(self) -> DataFrame:
        """``model, term, coef, hr, se, z, p, lower, upper``; nulls for dropped columns."""
        rows = []
        for m in self.models:
            for name, kept, coef, se in zip(m.names, m.kept, m.coef, m.standard_errors()):
                if not kept:
                    rows.append((m.model, name, *[None] * 7))
                    continue
                z = float(coef / se)
                rows.append(
                    (m.model, name, float(coef), _exp(coef), float(se), z, normal_two_sided(z),
                     _exp(coef - Z_95 * se), _exp(coef + Z_95 * se))
                )
        return self._frame(rows, "model string, term string, coef double, hr double, se double, z double, p double, lower double, upper double")

    def summary(self) -> DataFrame:
        """Size, likelihood ratio test, AIC and convergence per model."""
        rows = []
        for m in self.models:
            ratio = 2.0 * (m.loglik - m.loglik_null)
            df = int(m.kept.sum())
            rows.append((m.model, m.rows, m.events, m.loglik_null, m.loglik, ratio, df, chi_square_tail(ratio, df), float(m.aic()), bool(m.converged), m.steps))
        return self._frame(rows, "model string, n bigint, n_event bigint, loglik_null double, loglik double, lr double, df bigint, p double, aic double, converged boolean, steps int")

    def forest(self) -> DataFrame:
        """Per term and level: rows in the model, hazard ratio, interval and p; reference levels have ratio 1."""
        rows = []
        for m in self.models:
            at = 0
            for term in self.terms:
                width = len(term.names())
                if isinstance(term, Factor):
                    counts = np.rint(m.shares[at : at + width] * m.rows).astype(int)
                    rows.append((m.model, term.column, str(term.levels[0]), int(m.rows - counts.sum()), 1.0, None, None, None))
                    labels = [str(level) for level in term.levels[1:]]
                else:
                    counts = [m.rows] * width
                    labels = [None] if width == 1 else term.names()
                for i in range(width):
                    j = at + i
                    if m.kept[j]:
                        se = float(m.standard_errors()[j])
                        stats = (_exp(m.coef[j]), _exp(m.coef[j] - Z_95 * se), _exp(m.coef[j] + Z_95 * se), normal_two_sided(float(m.coef[j]) / se))
                    else:
                        stats = (None,) * 4
                    rows.append((m.model, term.column, labels[i], int(counts[i]), *stats))
                at += width
        return self._frame(rows, "model string, variable string, level string, n bigint, hr double, lower double, upper double, p double")

    def _constants(self) -> DataFrame:
        """Coefficients and scaling matrix, one row a model."""
        rows = [(m.model, np.where(m.kept, m.coef, 0.0).tolist(), (m.variance * m.events).tolist()) for m in self.models]
        return self._frame(rows, "model string, coef array<double>, scaling array<array<double>>")

    def _event_days(self) -> DataFrame:
        """Risk-set mean per model, stratum and event day; at most horizon rows a stratum."""
        rows = [
            (m.model, stratum, int(time), mean.tolist())
            for m in self.models
            for (stratum, time), mean in zip(m.pieces["times"].itertuples(index=False), m.pieces["x_means"])
        ]
        return self._frame(rows, "model string, stratum string, time int, x_mean array<double>")

    def residual_rows(self) -> DataFrame:
        """``p_id, model, stratum, time, resid, scaled`` of every event, residuals as arrays over the columns.

        Events meet the risk-set mean of their day; Spark broadcasts these few rows when they are below its threshold.
        """
        events = self.rows.filter(F.col("event") == 1).join(self._event_days(), ["model", "stratum", "time"])
        dot = lambda row: F.aggregate(F.zip_with(row, F.col("resid"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        joined = events.withColumn("resid", F.zip_with("x", "x_mean", lambda a, b: a - b)).join(self._constants(), "model")
        scaled = F.zip_with("coef", F.transform("scaling", dot), lambda c, v: c + v)
        return joined.select("p_id", "model", "stratum", "time", "resid", scaled.alias("scaled"))

    def schoenfeld(self) -> DataFrame:
        """``p_id, model, stratum, time, term, resid, scaled`` for every event and column."""
        names = F.array(*[F.lit(name) for name in self.models[0].names])
        cells = F.arrays_zip(names.alias("term"), F.col("resid").alias("resid"), F.col("scaled").alias("scaled"))
        flat = self.residual_rows().select("p_id", "model", "stratum", "time", F.inline(cells))
        return flat.toDF("p_id", "model", "stratum", "time", "term", "resid", "scaled")

    def combined_columns(self) -> dict[str, list[int]]:
        """Positions of the columns that make up each residual column.

        Every column stands for itself; the columns of a level in the separate strata of a ``ByStratum`` term
        also stand together, as the effect of that level over all of the follow-up.
        """
        names = self.models[0].names
        columns = {name: [i] for i, name in enumerate(names)}
        for term in self.terms:
            if isinstance(term, ByStratum):
                for level, parts in term.level_names().items():
                    columns[level] = [names.index(part) for part in parts]
        return columns

    def residual_covariance(self, column: str = "scaled") -> DataFrame:
        """``model, row_term, column_term, n, covariance`` of all residual columns, combined ones included.

        Null for columns that the model dropped; a combined column takes what is left of its parts.
        """
        columns = self.combined_columns()
        values = F.array(*[sum((F.col(column)[i] for i in parts[1:]), F.col(column)[parts[0]]) for parts in columns.values()])
        rows = self.residual_rows().select("model", values.alias("z"))
        shift = {m.model: [float(sum(m.coef[i] for i in parts if m.kept[i])) for parts in columns.values()] for m in self.models}
        missing = {m.model: {k for k, parts in enumerate(columns.values()) if not any(m.kept[i] for i in parts)} for m in self.models}
        return covariance(rows, list(columns), shift if column == "scaled" else None, missing)

    def ph_test(self) -> DataFrame:
        """Score test of a trend of each term's effect in 1 - S(t-), per term and overall."""
        rows = []
        for m in self.models:
            spans, at = [], 0
            for term in self.terms:
                width = len(term.names())
                spans.append((term.column, [j for j in range(at, at + width) if m.kept[j]]))
                at += width
            for name, chisq, df in _trend_tests(m, [*spans, ("GLOBAL", [j for j in range(at) if m.kept[j]])]):
                rows.append((m.model, name, chisq, df, chi_square_tail(chisq, df)))
        return self._frame(rows, "model string, term string, chisq double, df bigint, p double")

    def concordance(self) -> DataFrame:
        """Share of comparable pairs in which the earlier dropout has the higher risk score."""
        scored = None
        for m in self.models:
            beta = F.array(*[F.lit(float(c)) for c in np.where(m.kept, m.coef, 0.0)])
            risk = F.aggregate(F.zip_with("x", beta, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            part = self.rows.filter(F.col("model") == m.model).select("model", "time", "event", risk.alias("risk"))
            scored = part if scored is None else scored.unionByName(part)
        return concordance(scored)


def _trend_tests(m: CoxModel, spans: list[tuple[str, list[int]]]) -> list[tuple[str, float | None, int]]:
    times, deaths = m.pieces["times"]["time"].to_numpy(), m.pieces["deaths"]
    # Left-continuous survival of all rows together.
    frame = pd.DataFrame({"time": m.pieces["all_times"], "n": m.pieces["all_n"], "d": m.pieces["all_d"]})
    frame = frame.groupby("time", as_index=False).sum().sort_values("time")
    at_risk = frame["n"][::-1].cumsum()[::-1]
    before = np.r_[1.0, np.cumprod(1.0 - frame["d"] / at_risk)[:-1]]
    g = 1.0 - pd.Series(before, index=frame["time"]).loc[times].to_numpy()
    g = g - (g * deaths).sum() / deaths.sum()
    spreads = m.pieces["x_spreads"]
    u = (g[:, None] * m.pieces["x_residual_sums"]).sum(axis=0)
    i11 = spreads.sum(axis=0)
    i12 = (g[:, None, None] * spreads).sum(axis=0)
    i22 = ((g**2)[:, None, None] * spreads).sum(axis=0)
    kept = np.flatnonzero(m.kept)
    results = []
    for name, columns in spans:
        if not columns:
            results.append((name, None, 0))
            continue
        inner = i22[np.ix_(columns, columns)] - i12[np.ix_(columns, kept)] @ np.linalg.pinv(i11[np.ix_(kept, kept)]) @ i12[np.ix_(kept, columns)]
        results.append((name, float(u[columns] @ np.linalg.pinv(inner) @ u[columns]), len(columns)))
    return results


def coxph(
    matrix: DataFrame, terms: Sequence[Term], model: str | None = None, stratum: str | None = None, time: str = "duration",
    event: str = "event", max_steps: int = 200, tolerance: float = 1e-9,
) -> CoxFit:
    """Fit one model per value of ``model`` on a design matrix with the vector column ``x``.

    Steps go on until the log likelihood stays within ``tolerance``; a model that takes more than ``max_steps``
    is an error, so every fit that is returned has converged. ``max_steps=0`` evaluates everything at zero coefficients.
    """
    names = term_names(terms)
    width = len(names)
    rows = durable(
        matrix.select(
            "p_id",
            (F.lit("all") if model is None else F.col(model).cast("string")).alias("model"),
            (F.lit("") if stratum is None else F.col(stratum).cast("string")).alias("stratum"),
            F.col(time).cast("int").alias("time"),
            F.col(event).cast("int").alias("event"),
            "x",
        )
    )
    layout = _Layout(width)
    states = {}
    moments = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), Summarizer.metrics("mean", "std").summary(array_to_vector("x")).alias("s")
    )
    for row in moments.collect():
        mean, sd = row["s"]["mean"].toArray(), row["s"]["std"].toArray()
        states[row["model"]] = _State(mean, np.where(sd > 1e-12, sd, 1.0), row["n"], mean, np.zeros(width))
    active = dict(states)
    for step in range(max_steps + 1):
        table = _sums(rows, active, width)
        for name in list(active):
            state = active[name]
            at = _likelihood(table[table["model"] == name], state.beta, layout)
            if state.kept is None:
                state.kept, state.loglik_null = _independent(at["information"]), at["loglik"]
            done = state.previous is not None and abs(at["loglik"] - state.loglik) <= tolerance * abs(at["loglik"])
            if not done and state.previous is not None and at["loglik"] < state.loglik:
                state.beta = (state.beta + state.previous) / 2.0
                state.steps += 1
                continue
            state.loglik, state.pieces = at["loglik"], at
            if done or max_steps == 0:
                state.converged = True
                del active[name]
                continue
            kept = np.flatnonzero(state.kept)
            move = np.zeros(width)
            if len(kept):
                move[kept] = np.linalg.solve(at["information"][np.ix_(kept, kept)], at["gradient"][kept])
            state.previous, state.beta = state.beta, state.beta + move
            state.steps += 1
        if not active:
            break
    if active:
        raise RuntimeError(f"no convergence in {max_steps} steps: {sorted(active)}")
    return CoxFit(rows, [_in_original_units(name, names, states[name]) for name in sorted(states)], terms)


def _in_original_units(name: str, names: list[str], state: _State) -> CoxModel:
    """Undo the standardisation of coefficients, variance and per-day pieces."""
    at = state.pieces
    kept = np.flatnonzero(state.kept)
    beta = state.beta if state.converged else (state.previous if state.previous is not None else state.beta)
    variance = np.zeros((len(names), len(names)))
    if len(kept):
        variance[np.ix_(kept, kept)] = np.linalg.inv(at["information"][np.ix_(kept, kept)])
    variance = variance / np.outer(state.scale, state.scale)
    pieces = {
        **{key: at[key] for key in ("times", "deaths", "all_times", "all_n", "all_d")},
        "x_means": at["means"] * state.scale + state.center,
        "x_residual_sums": at["residual_sums"] * state.scale,
        "x_spreads": at["spreads"] * np.outer(state.scale, state.scale),
    }
    return CoxModel(
        name, names, np.where(state.kept, beta / state.scale, np.nan), state.kept, variance, state.rows, at["n_event"],
        state.loglik_null, state.loglik, state.converged, state.steps, state.level_share, pieces,
    )
