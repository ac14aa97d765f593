"""Do two judges agree? A stratified sample per question, agreement by tier, confusion matrix, disagreements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork import constants as K
from tallywork.functions.text import round_half_up
from tallywork.operators.ranking import head_and_tail
from tallywork.plans.evaluation import _all_of


def sample(pools: DataFrame, positions: DataFrame, order: list[Column], reverse: list[Column], n: int = K.SAMPLES_PER_TIER) -> DataFrame:
    """(query_id, job_id, pool_job_id, tier): best n, worst n of larger pools, and n of the next question's pool.

    `pools` has query_id and job_id, `positions` query_id and position (0-based, without gaps). A posting borrowed from
    the next question gets the prefix `cross_`; the last question borrows from the first.
    """
    top, bottom = head_and_tail(pools.select("query_id", "job_id", *_extra(pools)), ["query_id"], order, reverse, n)
    total = positions.count()
    borrower = positions.select(
        F.col("query_id").alias("borrower"), F.pmod(F.col("position") + 1, F.lit(max(total, 1))).alias("position")
    )
    next_of = borrower.join(positions, "position").select("borrower", "query_id")
    cross = top.join(next_of, "query_id").select(
        F.col("borrower").alias("query_id"),
        F.concat(F.lit("cross_"), F.col("job_id").cast("string")).alias("job_id"),
        F.col("job_id").alias("pool_job_id"),
        F.lit("cross").alias("tier"),
    )

    def own(part: DataFrame, tier: str) -> DataFrame:
        return part.select(
            "query_id", F.col("job_id").cast("string").alias("job_id"), F.col("job_id").alias("pool_job_id"), F.lit(tier).alias("tier")
        )

    return own(top, "top").unionByName(own(bottom, "bottom")).unionByName(cross)


def _extra(pools: DataFrame) -> list[str]:
    return [c for c in pools.columns if c not in ("query_id", "job_id")]


def paired_verdicts(samples: DataFrame, judgments: DataFrame, local: str, remote: str) -> DataFrame:
    """Samples with both judges' verdicts. Two equi-joins; a posting in two tiers counts twice."""

    def of(judge: str, name: str) -> DataFrame:
        return judgments.filter(F.col("judge") == judge).select("query_id", "job_id", F.col("verdict").alias(name))

    keys = ["query_id", "job_id"]
    return samples.join(of(local, "local"), keys).join(of(remote, "remote"), keys)


def _share(agreed: Column, total: Column) -> Column:
    return F.coalesce(round_half_up(agreed / F.nullif(total, F.lit(0)), 3), F.lit(0.0))


def agreement(pairs: DataFrame) -> DataFrame:
    """One row: sample size and share of equal verdicts."""
    agreed, total = F.count(F.when(F.col("local") == F.col("remote"), 1)), F.count(F.lit(1))
    return pairs.agg(total.alias("sample_size"), _share(agreed, total).alias("agreement"))


def agreement_by_tier(pairs: DataFrame) -> DataFrame:
    """(tier, total, agreed, agreement), all three tiers present."""
    agreed, total = F.count(F.when(F.col("local") == F.col("remote"), 1)), F.count(F.lit(1))
    tiers = pairs.groupBy("tier").agg(
        total.alias("total"), agreed.alias("agreed"), _share(agreed, total).alias("agreement")
    )
    return _all_of(tiers, "tier", K.TIERS).fillna(0, ["total", "agreed"]).fillna(0.0, ["agreement"])


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """(local, relevant, marginal, not_relevant): counts of the remote verdict per local verdict, zeros included."""
    counts = pairs.groupBy("local").agg(*[F.count(F.when(F.col("remote") == v, 1)).alias(v) for v in K.VERDICTS])
    return _all_of(counts, "local", K.VERDICTS).fillna(0, list(K.VERDICTS))


def disagreements(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("local") != F.col("remote")).select("query_id", "job_id", "tier", "local", "remote")
