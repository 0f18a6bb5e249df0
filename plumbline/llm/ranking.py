"""One ranking from several differently-scaled scores: first principal component of ranks."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import join_by_heat
from plumbline.operators.ordinals import running_totals
from plumbline.session import materialize

#: Values held by more than this share of the rows are hot; there can't be more than its inverse of them.
HOT_SHARE = 1 / 1000


def _ranks(rows: DataFrame, name: str, total: int, higher: bool) -> DataFrame:
    """``rows`` with ``above_<name>``, the number of better rows, and ``rank_<name>`` in (0, 1], 1 the best."""
    counts = rows.groupBy(F.col(name).alias("__v")).agg(F.count("*").alias("__n"))
    ranked = running_totals(counts, [F.desc("__v") if higher else F.asc("__v")], "__n", "__above")
    ranked = materialize(
        ranked.select("__v", "__n", F.col("__above").alias(f"above_{name}"), (1 - (F.col("__above") + (F.col("__n") - 1) / 2) / total).alias(f"rank_{name}")),
        "ranks",
    )
    # A hot value has its rows joined without a shuffle; the others can't make a large group.
    return join_by_heat(rows.withColumn("__v", F.col(name)), ranked, ["__v"], F.col("__n") > total * HOT_SHARE).drop("__v", "__n")


def first_component(correlation: np.ndarray) -> np.ndarray:
    """The loadings of the first principal component of scores that are oriented so that more is better.

    Of several components with the greatest variance (uncorrelated scores) it is
    the one nearest to equal loadings.  The component as a whole is turned so
    that its loadings sum to more than 0; if they sum to 0, so that the first one
    that isn't 0 is positive.
    """
    values, vectors = np.linalg.eigh(correlation)
    space = vectors[:, values > values[-1] - 1e-9]
    nearest = space @ space.sum(axis=0)
    if np.abs(nearest).max() < 1e-9:
        nearest = space[:, 0] * np.sign(space[np.flatnonzero(np.abs(space[:, 0]) > 1e-9)[0], 0])
    return nearest / np.linalg.norm(nearest)


def combined_ranking(rows: DataFrame, key: str, scores: Mapping[str, int]) -> DataFrame:
    """Rank ``rows`` by the first principal component of their rank-transformed scores.

    ``scores`` maps each score column to its direction: 1 if more is better, -1
    if less is.  Rows with a null or NaN in a score, or a null key, take no
    part.  Out come ``key``, the scores, for each score ``above_<score>`` (the
    number of rows that are strictly better) and ``rank_<score>`` (average rank
    of its ties over the number of rows, 1 the best), ``projection``,
    ``position`` (from 1; equal projections by key) and ``ranked``, the number of rows.

    The correlation matrix of the ranks, which are 1 for the best in the
    declared direction, is one distributed aggregation; see ``first_component``
    for its orientation.  Where scores disagree, the first component is the contrast
    between them, and a score then counts against its direction: of two scores with a
    negative correlation the second does.  That is what the component is; such
    scores have no common order to be found.  Scores without variation get
    loading 0 unless all have none, in which case all are equal.  An empty
    table gives no rows; repeated rows each have a position.
    """
    names = list(scores)
    kept = rows.select(F.col(key), *(F.col(c) for c in names)).dropna()
    kept = materialize(kept, "scores")
    total = kept.count()
    for name in names:
        kept = _ranks(kept, name, max(total, 1), scores[name] > 0)
    kept = materialize(kept, "ranked")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    got = kept.agg(
        *(F.covar_pop(f"rank_{a}", f"rank_{b}").alias(f"c{i}") for i, (a, b) in enumerate(pairs)),
    ).first()
    cov = np.zeros((len(names), len(names)))
    for i, (a, b) in enumerate(pairs):
        cov[names.index(a), names.index(b)] = cov[names.index(b), names.index(a)] = got[i] or 0.0
    spread = np.sqrt(np.diag(cov))
    scale = np.where(spread > 0, spread, 1.0)
    vary = np.flatnonzero(spread > 0) if spread.any() else np.arange(len(names))
    loadings = np.zeros(len(names))
    loadings[vary] = first_component((cov / np.outer(scale, scale))[np.ix_(vary, vary)])
    projection = sum((F.col(f"rank_{n}") - 0.5) * float(w / s) for n, w, s in zip(names, loadings, scale, strict=True))
    placed = kept.withColumn("projection", F.round(projection, 9)).withColumn("__one", F.lit(1))
    placed = running_totals(placed, [F.desc("projection"), F.asc(key)], "__one", "position")
    return placed.withColumn("position", F.col("position") + 1).withColumn("ranked", F.lit(total).cast("bigint")).drop("__one")
