"""Predictions carry only what is asked for."""

import random

from perennial.operators.features import FEATURES_V5
from perennial.plans import walkforward as WF


def test_predictions_carry_what_is_asked_for(spark):
    rnd = random.Random(11)
    names = list(dict.fromkeys((*WF.MODELS["v3"].features, *FEATURES_V5, "residual")))
    rows = [(f"T{t}", m, "carried", *[rnd.random() for _ in names]) for t in range(15) for m in range(6)]
    panel = spark.createDataFrame(
        rows, "ticker string, period_idx int, note string, " + ", ".join(f"{n} double" for n in names)
    )
    run = [WF.run_walk_forward(panel, "v3", 1, 5, training_months=3, keep=k) for k in (None, (), ("note",))]
    shared = ["ticker", "period_idx", "n_train", "prediction", "quality", "rank"]
    assert set(run[1].columns) == {*shared, "idio_volatility_6m"}
    assert set(run[2].columns) == {*shared, "idio_volatility_6m", "note"}
    # sums of other tasks differ in the last places
    found = [
        sorted((r.ticker, r.period_idx, r.n_train, round(r.prediction, 9), round(r.quality, 9), r.rank) for r in df.collect())
        for df in run
    ]
    assert len(found[0]) == 75 and found[0] == found[1] == found[2]
