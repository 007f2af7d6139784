"""Team-draft interleaving of two rankings and its click evaluation."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendwright.functions.tails import t_two_sided_udf

# Ship these helpers inside the task, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EPSILON = 1e-9


def ranked_lists(scores: DataFrame, session: str, doc: str, score_a: str, score_b: str, k: int) -> DataFrame:
    """The two rankings of every session as arrays, best first.

    A draft of ``k`` documents never looks past the first ``k`` of a list, so
    only those are collected; ``shared`` names the kept documents that both
    rankings contain anywhere.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    lists = []
    for name, score in (("ranking_a", score_a), ("ranking_b", score_b)):
        order = Window.partitionBy(session).orderBy(F.desc(score), doc)
        top = (
            scores.where(F.col(score).isNotNull())
            .withColumn("_r", F.row_number().over(order))
            .where(F.col("_r") <= k)
        )
        both = F.col(score_a).isNotNull() & F.col(score_b).isNotNull()
        pairs = F.sort_array(F.collect_list(F.struct("_r", F.col(doc).alias("d"), both.alias("both"))))
        lists.append(top.groupBy(session).agg(pairs.alias(name)))
    joined = lists[0].join(lists[1], session, "full_outer")
    empty = F.array().cast("array<string>")

    def docs(name: str, only_shared: bool = False) -> Column:
        items = F.filter(name, lambda s: s["both"]) if only_shared else F.col(name)
        return F.coalesce(F.transform(items, lambda s: s["d"].cast("string")), empty)

    return joined.select(
        session,
        docs("ranking_a").alias("ranking_a"),
        docs("ranking_b").alias("ranking_b"),
        F.array_union(docs("ranking_a", True), docs("ranking_b", True)).alias("shared"),
    )


def draft(ranking_a: Sequence, ranking_b: Sequence, shared: set, a_first: bool, k: int) -> tuple[list, list, list]:
    """One session's draft: the merged list and the documents each team owns."""
    ranks = {True: iter(ranking_a), False: iter(ranking_b)}
    placed: dict = {}
    turn = a_first
    while len(placed) < k:
        pick = next((d for d in ranks[turn] if d not in placed), None)
        if pick is None:
            break
        placed[pick] = turn
        turn = not turn
    merged = list(placed)
    team_a = [d for d in merged if placed[d] or d in shared]
    team_b = [d for d in merged if not placed[d] or d in shared]
    return merged, team_a, team_b


def team_draft(rankings: DataFrame, session: str, k: int, seed: int = 42, coin: str | None = None) -> DataFrame:
    """Draft every session's merged list.

    A coin column (1: ranking A starts) may be given; otherwise the coin is a
    hash of the session and the seed. Rankings are row-local arrays, so the
    draft is a map without a shuffle. Without a ``shared`` column the arrays
    are taken as complete rankings.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    flip = F.col(coin) if coin else F.pmod(F.xxhash64(F.col(session), F.lit(seed)), F.lit(2))
    shared = F.col("shared") if "shared" in rankings.columns else F.array_intersect("ranking_a", "ranking_b")
    rows = rankings.select(session, "ranking_a", "ranking_b", shared.alias("shared"), flip.cast("int").alias("coin"))
    texts = T.ArrayType(T.StringType())
    schema = T.StructType(
        [
            rows.schema[session],
            *[T.StructField(c, texts) for c in ("interleaved", "team_a", "team_b")],
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drafted = [
                draft(list(a), list(b), set(s), bool(c), k)
                for a, b, s, c in zip(batch["ranking_a"], batch["ranking_b"], batch["shared"], batch["coin"])
            ]
            yield pd.DataFrame(
                {
                    session: batch[session],
                    "interleaved": [d[0] for d in drafted],
                    "team_a": [d[1] for d in drafted],
                    "team_b": [d[2] for d in drafted],
                }
            )

    return rows.mapInPandas(run, schema)


def shown_documents(drafted: DataFrame, session: str) -> DataFrame:
    """One row per shown document with its team flags."""
    return drafted.select(session, "team_a", "team_b", F.explode("interleaved").alias("doc")).select(
        session,
        "doc",
        F.array_contains("team_a", F.col("doc")).alias("in_a"),
        F.array_contains("team_b", F.col("doc")).alias("in_b"),
    )


def interleaving_delta(shown: DataFrame, clicks: DataFrame, session: str) -> DataFrame:
    """Click credit and win margin per session.

    A click on a document of both teams counts one half for each; the stored
    click counts are doubled to stay whole.
    """
    clicked = clicks.select(session, F.col("doc").cast("string").alias("doc")).distinct().withColumn("_hit", F.lit(True))
    joined = shown.withColumn("doc", F.col("doc").cast("string")).join(clicked, [session, "doc"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    both = F.col("in_a") & F.col("in_b")

    def credit(own: str) -> Column:
        return F.sum(F.when(hit & both, 1).when(hit & F.col(own), 2).otherwise(0))

    sums = joined.groupBy(session).agg(credit("in_a").alias("clicks_a"), credit("in_b").alias("clicks_b"))
    a, b = F.col("clicks_a") / 2.0, F.col("clicks_b") / 2.0
    return sums.withColumn("delta", (b - a) / (a + b + EPSILON))


def interleaving_experiment(deltas: DataFrame, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """One-sample t-test of the win margins and the winning ranking."""
    sums = deltas.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.avg("delta").alias("mean_delta"),
        F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("std_delta"),
        F.sum("clicks_a").alias("total_clicks_a"),
        F.sum("clicks_b").alias("total_clicks_b"),
    )
    spread = (F.col("n_trials") > 1) & (F.col("std_delta") > 1e-12)
    t = F.when(spread, F.col("mean_delta") / (F.col("std_delta") / F.sqrt("n_trials"))).otherwise(0.0)
    tested = sums.withColumn("t_statistic", t)
    tail = t_two_sided_udf("t_statistic", F.greatest(F.col("n_trials") - 1, F.lit(1)).cast("double"))
    tested = tested.withColumn("p_value", F.when(spread, tail).otherwise(1.0))
    winner = F.when(F.col("p_value") > alpha, "tie").when(F.col("mean_delta") > 0, "B").otherwise("A")
    return tested.withColumn("winner", winner)
