"""The comparison report of several streams, and its SQL tail of the chi-square distribution."""

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortwise.functions.pvalues import chi_square_p
from cohortwise.operators import compare
from oracle.queries import _tail


def test_report_by_stream_keeps_tests_apart(spark):
    numbers = spark.createDataFrame(
        [("a", "age", "C1", 30.125, 20.0, 40.0), ("b", "age", "C1", None, None, None)], "stream string, variable string, stratum string, median double, q1 double, q3 double"
    )
    levels = spark.createDataFrame([("a", "sex", "f", "C1", 3, 75.0), ("b", "sex", "f", "C1", 1, 100.0)], "stream string, variable string, level string, stratum string, n long, pct double")
    tests = spark.createDataFrame([("a", "age", 0.0004), ("b", "age", None), ("b", "sex", 0.25)], "stream string, variable string, p double")
    report = compare.comparison_report(numbers, levels, tests, [("people", ["age", "sex"])], ["stream"])
    found = {(r.stream, r.ord): (r.text, r.p_text) for r in report.collect()}
    assert found == {("a", 1): ("30.12 [20.00, 40.00]", "<0.001"), ("b", 1): (None, None), ("a", 2): ("3 (75.0)", None), ("b", 2): ("1 (100.0)", "0.250")}


@pytest.mark.parametrize("statistic, df", [(0.3, 1), (3.0, 3), (14.2, 6), (40.0, 12), (390.0, 3)])
def test_tail_of_the_sql(spark, statistic, df):
    ours = spark.range(1).select(chi_square_p(F.lit(statistic), F.lit(float(df)))).first()[0]
    theirs = duckdb.sql(f"SELECT {_tail(f'CAST({statistic} AS DOUBLE)', str(df))}").fetchall()[0][0]
    assert ours == pytest.approx(theirs, abs=1e-10)
