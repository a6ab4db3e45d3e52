"""Participant-engagement analytics on Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame; nothing is executed
until the caller acts on the result, except for the iterative models (Cox,
k-means), which run one distributed aggregation per iteration.
"""

from cohortwise.config import COHORT_1, COHORT_2, Cohort

__all__ = ["COHORT_1", "COHORT_2", "Cohort"]
