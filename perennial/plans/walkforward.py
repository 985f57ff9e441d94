"""Walk-forward ranking models over the monthly panel.

One parametrised plan covers all model versions: membership filter, target, features, rolling ridge,
predictions.  The order matters: targets and standardised features see members only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perennial.functions.storage import materialize
from perennial.operators.crosssection import (
    PERIOD,
    beta_neutral_target,
    residual_target,
    standardized_features,
    winsor_zscore,
)
from perennial.operators.evaluation import monthly_diagnostics
from perennial.operators.facts import ANNUAL_FEATURES, QUARTERLY_FEATURES
from perennial.operators.features import FEATURES_V3, FEATURES_V5
from perennial.operators.ridge import (
    alpha_quality,
    predict_rank,
    walk_forward_predictions,
)
from perennial.operators.sectors import SECTOR_FEATURES


@dataclass(frozen=True)
class Model:
    """What distinguishes a model version."""

    features: Sequence[str]
    target: str
    prepare: Callable[[DataFrame], DataFrame]
    outcome: str = "residual"
    residual: str = "residual"
    required: tuple[str, ...] = ()
    #: months with fewer complete rows are not predicted
    min_test_rows: int = 30
    rank: Callable[[DataFrame], DataFrame] = predict_rank
    #: columns of the panel that ``rank`` reads
    rank_by: tuple[str, ...] = ()


def _fundamental(names: Sequence[str]) -> Model:
    return Model(
        features=[*[f"cs_{n}" for n in names], *[f"missing_{n}" for n in names]],
        target="beta_neutral_target",
        prepare=lambda df: winsor_zscore(beta_neutral_target(df), names),
        outcome="beta_neutral_target",
        residual="beta_neutral_return",
        required=("beta_neutral_return",),
    )


MODELS = {
    "v3": Model(
        FEATURES_V3, "residual", lambda df: df, min_test_rows=10, rank=alpha_quality,
        rank_by=("idio_volatility_6m",),
    ),
    "v5": Model(FEATURES_V5, "residual_target", residual_target),
    "v6": Model(
        [f"cs_{f}" for f in FEATURES_V5],
        "residual_target",
        lambda df: standardized_features(residual_target(df), FEATURES_V5),
    ),
    "v7": Model(FEATURES_V5, "beta_neutral_target", beta_neutral_target),
    "v8": Model((*FEATURES_V5, *SECTOR_FEATURES), "beta_neutral_target", beta_neutral_target),
    "v8b": _fundamental(ANNUAL_FEATURES),
    "v8c": _fundamental(QUARTERLY_FEATURES),
}


def store_by_month(panel: DataFrame) -> DataFrame:
    """The panel as a stored table with one folder per month, so that a run reads only its months.

    Rows are ranged by month and ticker first: a task writes to few folders, and a month that holds
    many rows is written by many tasks.
    """
    return materialize(panel.repartitionByRange(PERIOD, "ticker"), "panel", (PERIOD,))


def members_only(panel: DataFrame, membership: DataFrame) -> DataFrame:
    """Rows whose ticker is a member in that month; a month without membership has none.

    The distinct months, one row per calendar month, are broadcast: over a panel stored by month they
    prune the folders at run time.  Members themselves are joined as their size allows.
    """
    members = membership.select(PERIOD, "ticker")
    months = F.broadcast(members.select(PERIOD).distinct())
    return panel.join(months, PERIOD, "left_semi").join(members, [PERIOD, "ticker"], "left_semi")


def run_walk_forward(
    panel: DataFrame,
    model: Model | str,
    start: int,
    end: int,
    membership: DataFrame | None = None,
    training_months: int = 120,
    alpha: float = 10.0,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Ranked out-of-sample predictions; ``start`` and ``end`` are month indexes.

    The panel is read several times: pass a stored one, with ``membership`` one stored by month.
    ``keep`` names the columns that the result has besides ticker, month and what the model adds; without
    it every column is stored and shuffled with the predictions.
    """
    spec = MODELS[model] if isinstance(model, str) else model
    in_range = F.col(PERIOD).between(start - training_months, end)
    rows = panel.where(in_range)
    if membership is not None:
        members = materialize(membership.where(in_range), "members")
        rows = members_only(rows, members.where(in_range))
    ready = spec.prepare(rows)
    carried = [*dict.fromkeys((PERIOD, "ticker", *(keep or ()), *spec.rank_by))]
    if keep is not None:
        ready = ready.select(*dict.fromkeys((*carried, *spec.features, spec.target)))
    prepared = materialize(ready, "prepared")
    predicted = walk_forward_predictions(
        prepared, spec.features, spec.target, start, end, training_months, alpha, spec.min_test_rows
    )
    if keep is not None:
        predicted = predicted.select(*carried, "n_train", "prediction")
    scored = materialize(predicted, "predictions")
    return spec.rank(scored)


def diagnose(predictions: DataFrame, model: Model | str) -> DataFrame:
    """Monthly results of a version with that version's outcome and residual columns."""
    spec = MODELS[model] if isinstance(model, str) else model
    return monthly_diagnostics(
        predictions, spec.outcome, spec.residual, "residual", required=spec.required
    )
