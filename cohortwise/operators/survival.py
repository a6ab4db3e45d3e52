"""Retention: dropout labels, Kaplan-Meier curves, episode splitting, design matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.calendar import day_in_study
from cohortwise.functions.coding import one_hot

# Fixed value: 97.5 % point of the standard normal distribution.
Z_95 = 1.959963984540054


def dropout_wide(base: DataFrame, last: DataFrame, streams: Sequence[str], horizon: int, offsets: Mapping[str, int] | None = None) -> DataFrame:
    """``base`` (with ``enrollment_date``) plus ``duration_<stream>`` and ``event_<stream>``.

    ``last`` is the wide last-activity table. The duration is the day difference
    of the last record inside the horizon plus the stream's offset, 0 without
    any record; records before enrolment give negative durations. The event is 1
    when even the grace window ends before the horizon, otherwise the
    participant is censored.
    """
    joined = base.join(last, "p_id", "left")
    columns = {}
    for stream in streams:
        offset = (offsets or {}).get(stream, 0)
        inside = day_in_study(F.to_date(f"last_h_{stream}"), "enrollment_date", offset)
        later = day_in_study(F.to_date(f"last_grace_{stream}"), "enrollment_date", offset)
        columns[f"duration_{stream}"] = F.coalesce(inside, F.lit(0))
        columns[f"event_{stream}"] = (F.coalesce(later, F.lit(0)) < horizon).cast("int")
    dropped = [f"{label}_{stream}" for stream in streams for label in ("last_h", "last_grace")]
    return joined.withColumns(columns).drop(*dropped)


def dropout_long(wide: DataFrame, streams: Sequence[str], keep: Sequence[str] = ("p_id",)) -> DataFrame:
    """Long form ``(keep, stream, duration, event)`` of the wide labels, without a shuffle."""
    cells = F.array(
        *[
            F.struct(F.lit(s).alias("stream"), F.col(f"duration_{s}").alias("duration"), F.col(f"event_{s}").alias("event"))
            for s in streams
        ]
    )
    return wide.select(*keep, F.inline(cells))


def km_curve(labels: DataFrame, by: Sequence[str] = ("stream",), time: str = "duration", event: str = "event") -> DataFrame:
    """Product-limit curve per group: at risk, events, censored and S(t) at each observed time.

    Participants are first counted per group and whole-day time; the ordered
    windows then run over at most horizon + 1 rows (plus negative days) a group.
    """
    counts = labels.groupBy(*by, F.col(time).alias("time")).agg(
        F.sum(event).alias("n_event"), F.sum(F.lit(1) - F.col(event)).alias("n_censor")
    )
    backwards = Window.partitionBy(*by).orderBy(F.desc("time"))
    forwards = Window.partitionBy(*by).orderBy("time")
    at_risk = counts.withColumn("n_risk", F.sum(F.col("n_event") + F.col("n_censor")).over(backwards))
    step = F.lit(1.0) - F.col("n_event") / F.col("n_risk")
    return at_risk.withColumn("surv", F.product(step).over(forwards)).select(
        *by, "time", "n_risk", "n_event", "n_censor", "surv"
    )


def km_confidence(curve: DataFrame, by: Sequence[str] = ("stream",)) -> DataFrame:
    """Greenwood error of ln S(t) and the log-scale 95 % interval; no interval once S is 0."""
    forwards = Window.partitionBy(*by).orderBy("time")
    part = F.try_divide(F.col("n_event").cast("double"), F.col("n_risk") * (F.col("n_risk") - F.col("n_event")))
    se = F.when(F.col("surv") > 0, F.sqrt(F.sum(part).over(forwards)))
    return curve.withColumn("se", se).withColumns(
        {
            "lower": F.col("surv") * F.exp(F.lit(-Z_95) * F.col("se")),
            "upper": F.least(F.col("surv") * F.exp(F.lit(Z_95) * F.col("se")), F.when(F.col("se").isNotNull(), F.lit(1.0))),
        }
    )


def km_median(curve: DataFrame, by: Sequence[str] = ("stream",)) -> DataFrame:
    """Median survival: first time with S <= 0.5; the middle of the step when S stays at exactly 0.5."""
    near = F.lit(1e-9)
    reached = F.min(F.when(F.col("surv") <= F.lit(0.5) + near, F.col("time")))
    passed = F.min(F.when(F.col("surv") < F.lit(0.5) - near, F.col("time")))
    flat = F.max(F.when(F.abs(F.col("surv") - F.lit(0.5)) <= near, F.lit(1)))
    middle = (reached + F.coalesce(passed, reached)) / F.lit(2.0)
    return curve.groupBy(*by).agg(F.when(flat == 1, middle).otherwise(reached.cast("double")).alias("median_time"))


def episode_split(labels: DataFrame, cuts: Sequence[int], start: int = -1, time: str = "duration", event: str = "event") -> DataFrame:
    """Split each follow-up at the cut points into ``(tgroup, tstart, tstop, event)`` rows.

    The event is kept in the last episode only. A follow-up that ends before
    ``start`` stays as one first-group row that opens a day before its end, so
    nobody is lost. The rows are unfolded in place.
    """
    bounds = [start, *cuts]
    cells = []
    for index, low in enumerate(bounds):
        high = bounds[index + 1] if index + 1 < len(bounds) else None
        stop = F.col(time) if high is None else F.least(F.col(time), F.lit(high))
        begin = F.least(F.lit(low), F.col(time) - F.lit(1)) if index == 0 else F.lit(low)
        cell = F.struct(
            F.lit(index + 1).alias("tgroup"),
            begin.cast("int").alias("tstart"),
            stop.cast("int").alias("tstop"),
            F.when(stop == F.col(time), F.col(event)).otherwise(F.lit(0)).cast("int").alias("event"),
        )
        cells.append(cell if index == 0 else F.when(F.col(time) > F.lit(low), cell))
    kept = [name for name in labels.columns if name not in (time, event)]
    return labels.select(*kept, F.inline(F.array_compact(F.array(*cells))))


@dataclass(frozen=True)
class Factor:
    """Categorical term; the first level is the reference."""

    column: str
    levels: tuple

    def names(self) -> list[str]:
        return [f"{self.column}={level}" for level in self.levels[1:]]

    def columns(self):
        return one_hot(self.column, self.levels)


@dataclass(frozen=True)
class Numeric:
    """Numeric term."""

    column: str

    def names(self) -> list[str]:
        return [self.column]

    def columns(self):
        return [F.col(self.column).cast("double")]


@dataclass(frozen=True)
class ByStratum:
    """Effect of a factor within each stratum: one column per level and stratum value.

    All levels are coded; the model drops the columns that are linearly dependent.
    """

    factor: Factor
    stratum: str
    values: tuple

    def names(self) -> list[str]:
        return [f"{self.factor.column}={l}:{self.stratum}={v}" for v in self.values for l in self.factor.levels]

    def level_names(self) -> dict[str, list[str]]:
        """For each level the names of its columns over the strata."""
        return {f"{self.factor.column}={l}:{self.stratum}": [f"{self.factor.column}={l}:{self.stratum}={v}" for v in self.values] for l in self.factor.levels}

    @property
    def column(self) -> str:
        return f"{self.factor.column}:{self.stratum}"

    def columns(self):
        coded = one_hot(self.factor.column, self.factor.levels, drop_reference=False)
        return [(F.col(self.stratum) == F.lit(v)).cast("double") * level for v in self.values for level in coded]


Term = Factor | Numeric | ByStratum


def term_names(terms: Sequence[Term]) -> list[str]:
    return [name for term in terms for name in term.names()]


def design_matrix(df: DataFrame, terms: Sequence[Term], keep: Sequence[str], name: str = "x") -> DataFrame:
    """``keep`` plus the covariate vector ``x``; rows with any missing covariate are left out."""
    columns = [column for term in terms for column in term.columns()]
    coded = df.select(*keep, F.array(*columns).alias(name))
    return coded.filter(F.forall(name, lambda value: value.isNotNull()))


def design_columns(matrix: DataFrame, width: int, keep: Sequence[str], name: str = "x") -> DataFrame:
    """The vector spread over columns ``x_1 .. x_p``."""
    return matrix.select(*keep, *[F.element_at(name, i + 1).alias(f"{name}_{i + 1}") for i in range(width)])
