"""Clinical-outcome summaries over a ``patients`` table
(patient_id, age, age_group, group, baseline_score, followup_score,
recovery_days, completed_programme, score_improvement)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.scalar import np_round, sql_round


def group_summary(patients: DataFrame, group_col: str = "group") -> DataFrame:
    """n, mean baseline / follow-up / improvement / recovery days and completers per group."""
    return (patients.groupBy(group_col)
            .agg(F.count(F.lit(1)).alias("n"),
                 sql_round(F.avg("baseline_score"), 2).alias("avg_baseline"),
                 sql_round(F.avg("followup_score"), 2).alias("avg_followup"),
                 sql_round(F.avg("score_improvement"), 2).alias("avg_improvement"),
                 sql_round(F.avg("recovery_days"), 1).alias("avg_recovery_days"),
                 F.sum(F.when(F.col("completed_programme"), F.lit(1)).otherwise(F.lit(0)))
                 .cast("bigint").alias("completed_n")))


def group_means(patients: DataFrame, cols=("baseline_score", "followup_score", "recovery_days"),
                group_col: str = "group") -> DataFrame:
    """``groupby(group)[cols].mean().round(2)`` (numpy rounding)."""
    return patients.groupBy(group_col).agg(*[np_round(F.avg(c), 2).alias(c) for c in cols])


def age_group_summary(patients: DataFrame) -> DataFrame:
    """n, mean and sample standard deviation of score improvement per age band."""
    return (patients.groupBy("age_group")
            .agg(F.count(F.lit(1)).alias("n"),
                 sql_round(F.avg("score_improvement"), 2).alias("avg_improvement"),
                 sql_round(F.stddev_samp("score_improvement"), 2).alias("std_improvement"))
            .orderBy(F.col("age_group").asc_nulls_last()))
