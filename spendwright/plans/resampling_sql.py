"""The row bootstrap as SQL, for checks."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from spendwright.operators.bootstrap import PER_DIGEST, digest_sql, weight_sql


def draws(rows: str, key: Sequence[str], columns: Sequence[str], replicates: int, seed: int = 42) -> str:
    """``boot_draws``: every row of a relation once per replicate, with its weight ``w``."""
    kept = ", ".join(columns)
    return f"""
boot_digests AS (SELECT {kept}, b, {digest_sql(key, "b", seed)} AS digest FROM {rows}, range({-(-replicates // PER_DIGEST)}) AS t(b)),
boot_draws AS (SELECT {kept}, b * {PER_DIGEST} + j AS replicate, {weight_sql("digest", "j")} AS w
  FROM boot_digests, range({PER_DIGEST}) AS u(j) WHERE b * {PER_DIGEST} + j < {replicates})"""


def sums(rows: str, key: Sequence[str], stats: Sequence[str], by: Sequence[str], replicates: int, seed: int = 42) -> str:
    """``boot``: the weighted sums of columns per group and replicate, and ``one``, the sum of weights."""
    groups = "".join(f"{b}, " for b in by)
    added = ", ".join(f"sum(w * {s}) AS {s}" for s in stats)
    return draws(rows, key, [*by, *stats], replicates, seed) + f""",
boot AS (SELECT {groups}replicate, CAST(sum(w) AS DOUBLE) AS one, {added} FROM boot_draws GROUP BY {groups}replicate)"""


def interval(statistic: str, by: Sequence[str] = (), confidence: float = 0.95) -> str:
    """The percentile interval of a statistic of ``boot``."""
    tail = (1 - confidence) / 2
    groups = ", ".join(by)
    chosen = f"SELECT {groups + ', ' if by else ''}quantile_cont({statistic}, {tail}) AS ci_lower, quantile_cont({statistic}, {1 - tail}) AS ci_upper FROM boot"
    return chosen + (f" GROUP BY {groups}" if by else "")


def slope(names: Sequence[str]) -> tuple[list[str], str]:
    """(columns, CTEs) of the coefficient ``ate`` per replicate.

    ``names`` are centred regressors, the treatment and the outcome. The columns
    are products ``p_i_j``; regressors are swept out of the products one by one.
    """
    size = len(names)
    pairs = list(combinations_with_replacement(range(size), 2))
    products = [f"{names[i]} * {names[j]} AS p_{i}_{j}" for i, j in pairs]
    text = ",\nsweep AS (SELECT replicate, " + ", ".join(f"p_{i}_{j} - {names[i]} * {names[j]} / one AS s_{i}_{j}" for i, j in pairs) + " FROM boot)"
    source = "sweep"
    for k in range(size - 2):
        left = [(i, j) for i, j in pairs if i > k]
        target = f"sweep{k}"
        text += f",\n{target} AS (SELECT replicate, " + ", ".join(f"s_{i}_{j} - s_{k}_{i} * s_{k}_{j} / s_{k}_{k} AS s_{i}_{j}" for i, j in left) + f" FROM {source})"
        source = target
    t, y = size - 2, size - 1
    return products, text + f",\nsolved AS (SELECT replicate, s_{t}_{y} / s_{t}_{t} AS ate FROM {source})"


def ols(source: str, regressors: Sequence[str], treatment: str, outcome: str) -> str:
    """The treatment coefficient of a relation as a scalar subquery."""
    names = [*regressors, treatment, outcome]
    centred = ["c_" + n for n in names]
    products, solved = slope(centred)
    added = [f"sum({c}) AS {c}" for c in centred] + [f"sum({p.split(' AS ')[0]}) AS {p.split(' AS ')[1]}" for p in products]
    return f"""(WITH c AS (SELECT {", ".join(f"{n} - avg({n}) OVER () AS {c}" for n, c in zip(names, centred))} FROM {source}),
boot AS (SELECT 0 AS replicate, CAST(count(*) AS DOUBLE) AS one, {", ".join(added)} FROM c){solved} SELECT ate FROM solved)"""


def two_sided(z: str) -> str:
    """The two-sided normal tail by a series of positive terms."""
    x = f"greatest({z} / sqrt(2.0), 1e-300)"
    terms = f"list_sum(list_transform(range(0, 250), lambda k: exp((2 * k + 1) * ln({x}) - {x} * {x} - lgamma(k + 1.5))))"
    return f"CASE WHEN {z} > 9 THEN 0.0 ELSE least(greatest(1 - {terms}, 0), 1) END"
