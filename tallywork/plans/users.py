"""Bookmarks and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.operators.joins import hot_key_join


def favorite_jobs(favorites: DataFrame, jobs: DataFrame) -> DataFrame:
    """Bookmarked postings with user and time. A posting everybody saves is spread over tasks."""
    return hot_key_join(favorites, jobs.withColumnRenamed("id", "job_id"), "job_id", "inner", ["user_id"])


def favorites_of(favorites: DataFrame, jobs: DataFrame, user_id: object) -> DataFrame:
    """One user's bookmarks, newest first."""
    mine = favorites.filter(F.col("user_id") == F.lit(user_id))
    return favorite_jobs(mine, jobs).orderBy(F.desc_nulls_last("saved_at"), F.asc("job_id"))


def with_saved_flag(jobs: DataFrame, favorites: DataFrame, user_id: object) -> DataFrame:
    """Postings with `is_saved` for one user."""
    mine = favorites.filter(F.col("user_id") == F.lit(user_id)).select(F.col("job_id").alias("id")).distinct()
    return (
        jobs.join(mine.withColumn("_saved", F.lit(True)), "id", "left")
        .withColumn("is_saved", F.col("_saved").isNotNull())
        .drop("_saved")
    )


def with_resume_flag(users: DataFrame, resumes: DataFrame) -> DataFrame:
    """Users with `has_resume`."""
    owners = resumes.select(F.col("user_id").alias("id")).distinct().withColumn("_resume", F.lit(True))
    return users.join(owners, "id", "left").withColumn("has_resume", F.col("_resume").isNotNull()).drop("_resume")
