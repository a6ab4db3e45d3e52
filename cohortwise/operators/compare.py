"""Group comparison: table one, Kruskal-Wallis, chi-square and the stacked report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.nulls import null_safe_join
from cohortwise.functions.pvalues import chi_square_p
from cohortwise.operators.describe import melt
from cohortwise.operators.ranks import quantile_column, rank_sums, running_counts, value_counts
from cohortwise.sources.durable import durable


def table_one_continuous(df: DataFrame, columns: Sequence[str], stratum: str | None) -> DataFrame:
    """Median and quartiles per variable and stratum with the number of known and missing values."""
    strata = F.lit("Overall") if stratum is None else F.col(stratum).cast("string")
    long = melt(df.withColumn("stratum", strata), ["stratum"], columns)
    return quantile_table(durable(value_counts(long.filter(F.col("stratum").isNotNull()), ["variable", "stratum"])))


def quantile_table(counts: DataFrame) -> DataFrame:
    """The same from durable value counts ``(variable, stratum, value, n)`` in which nulls are counted."""
    keys = ["variable", "stratum"]
    missing = counts.groupBy(*keys).agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_missing"),
    )
    ranked = running_counts(counts.filter(F.col("value").isNotNull()), keys, bucket_by="variable", pinned=True)
    spread = ranked.groupBy(*keys).agg(
        *[quantile_column(p).alias(name) for name, p in {"q1": 0.25, "median": 0.5, "q3": 0.75}.items()]
    )
    return missing.join(spread, keys, "left")


def table_one_categorical(df: DataFrame, columns: Sequence[str], stratum: str | None) -> DataFrame:
    """Count and percentage of each level per variable and stratum; percentages over known values."""
    strata = F.lit("Overall") if stratum is None else F.col(stratum).cast("string")
    long = melt(df.withColumn("stratum", strata), ["stratum"], columns, "string").withColumnRenamed("value", "level")
    known = long.filter(F.col("stratum").isNotNull() & F.col("level").isNotNull())
    counts = known.groupBy("variable", "level", "stratum").agg(F.count(F.lit(1)).alias("n"))
    of_all = F.sum("n").over(Window.partitionBy("variable", "stratum"))
    return counts.withColumn("pct", F.col("n") * F.lit(100.0) / of_all)


def kruskal_wallis(df: DataFrame, columns: Sequence[str], group: str, with_p: bool = True) -> DataFrame:
    """Kruskal-Wallis H with tie correction per column; rows with a missing value or group are left out."""
    long = melt(df.filter(F.col(group).isNotNull()), [group], columns).filter(F.col("value").isNotNull())
    return kruskal_from_counts(durable(value_counts(long, ["variable", group])), group, with_p)


def kruskal_from_counts(counts: DataFrame, group: str, with_p: bool = True) -> DataFrame:
    """The same from durable value counts ``(variable, group, value, n)``; ``h`` is null when all values tie."""
    sums = rank_sums(counts, "variable", group, pinned=True)
    total = F.max("total").cast("double")
    between = F.lit(12.0) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n"))
    raw = between / (total * (total + 1)) - F.lit(3.0) * (total + 1)
    ties = F.lit(1.0) - F.try_divide(F.sum("tie_part"), total * total * total - total)
    result = sums.groupBy("variable").agg(
        F.sum("n").alias("n"), (F.count(F.lit(1)) - F.lit(1)).alias("df"), F.try_divide(raw, ties).alias("h")
    )
    return result.withColumn("p", chi_square_p(F.col("h"), F.col("df").cast("double"))) if with_p else result


def code_levels(df: DataFrame, levels: dict[str, Sequence]) -> DataFrame:
    """Replace categories by their position in a level list so that they can be ranked."""
    return df.withColumns(
        {
            name: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name)).cast("double")
            for name, values in levels.items()
        }
    )


def chi_square(cells: DataFrame, keys: Sequence[str], row: str, column: str, with_p: bool = True) -> DataFrame:
    """Pearson chi-square from contingency counts ``(keys, row, column, n)``.

    Uses ``N * (sum(O^2 / (R * C)) - 1)``, so empty cells need not be listed. A
    2 x 2 table gets the continuity correction, at most the size of the deviation.
    """
    by = list(keys)
    enriched = cells.withColumns(
        {
            "row_total": F.sum("n").over(Window.partitionBy(*by, row)),
            "column_total": F.sum("n").over(Window.partitionBy(*by, column)),
            "total": F.sum("n").over(Window.partitionBy(*by)),
            "in_row": F.count(F.lit(1)).over(Window.partitionBy(*by, row)),
            "in_column": F.count(F.lit(1)).over(Window.partitionBy(*by, column)),
        }
    )
    n, r, c, total = (F.col(name).cast("double") for name in ("n", "row_total", "column_total", "total"))
    stats = enriched.groupBy(*by).agg(
        F.max("total").alias("n"),
        F.sum(F.lit(1.0) / F.col("in_row")).alias("rows"),
        F.sum(F.lit(1.0) / F.col("in_column")).alias("columns"),
        F.sum(n * n / (r * c)).alias("share"),
        F.max(F.abs(n - r * c / total)).alias("deviation"),
        F.sum(F.lit(1.0) / (r * F.col("in_row"))).alias("inverse_rows"),
        F.sum(F.lit(1.0) / (c * F.col("in_column"))).alias("inverse_columns"),
    )
    rows, columns = F.round("rows").cast("bigint"), F.round("columns").cast("bigint")
    corrected = F.col("deviation") - F.least(F.lit(0.5), F.col("deviation"))
    two_by_two = corrected * corrected * F.col("n") * F.col("inverse_rows") * F.col("inverse_columns")
    plain = F.col("n") * (F.col("share") - F.lit(1.0))
    result = stats.select(
        *by,
        F.when((rows == 2) & (columns == 2), two_by_two).otherwise(plain).alias("chi2"),
        ((rows - 1) * (columns - 1)).alias("df"),
        F.col("n"),
    )
    return result.withColumn("p", chi_square_p(F.col("chi2"), F.col("df").cast("double"))) if with_p else result


def contingency(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of the level pairs of two columns, rows with a missing level left out."""
    known = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    return known.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))


def comparison_report(
    continuous: DataFrame, categorical: DataFrame, tests: DataFrame, sections: Sequence[tuple[str, Sequence[str]]], by: Sequence[str] = ()
) -> DataFrame:
    """Stacked text table: one row per variable, level and stratum in named sections, for each level of ``by``.

    Continuous rows read "median [q1, q3]" (no text where no value is known), categorical rows "n (pct)".
    A test that cannot be made has no text.
    """
    def number(name: str, digits: int = 2):
        return F.when(F.col(name).isNotNull(), F.format_string(f"%.{digits}f", F.bround(F.col(name), digits)))

    spread = F.concat(number("median"), F.lit(" ["), number("q1"), F.lit(", "), number("q3"), F.lit("]"))
    share = F.concat(F.col("n").cast("string"), F.lit(" ("), number("pct", 1), F.lit(")"))
    rows = continuous.select(*by, "variable", F.lit(None).cast("string").alias("level"), "stratum", spread.alias("text")).unionByName(
        categorical.select(*by, "variable", "level", "stratum", share.alias("text"))
    )
    section, order, place = None, None, 0
    for name, variables in sections:
        for variable in variables:
            place += 1
            test = F.col("variable") == variable
            section = F.when(test, F.lit(name)) if section is None else section.when(test, F.lit(name))
            order = F.when(test, F.lit(place)) if order is None else order.when(test, F.lit(place))
    p_text = F.when(F.col("p") < 0.001, F.lit("<0.001")).otherwise(number("p", 3)).alias("p_text")
    placed = rows.withColumns({"section": section, "ord": order}).filter(F.col("section").isNotNull())
    joined = null_safe_join(placed, tests.select(*by, "variable", "p"), [*by, "variable"], "left")
    return joined.select(*by, "section", "ord", "variable", "level", "stratum", "text", p_text)
