"""Changing the future leaves the past as it was."""

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import backtest as K
from tapeloom.operators import features as X
from tapeloom.operators import quality as Q
from tapeloom.operators import signals as S
from tests import frames as f

CUT = 200


@pytest.fixture(scope="module")
def pair(spark):
    a = f.walk(300, 7)
    b = a[:CUT] + f.walk(100, 8, 0.05, a[CUT - 1])
    vol = [100.0 + (i * 37 % 11) for i in range(300)]
    vol2 = vol[:CUT] + [v * 3 for v in vol[CUT:]]
    ofi = F.sin(F.col("close") * 50)
    return [f.bars(spark, c, volume=v).withColumn("ofi", ofi) for c, v in ((a, vol), (b, vol2))]


OPERATORS = {
    "ma": lambda d: S.ma_crossover(d, 5, 20),
    "bollinger": lambda d: S.bollinger_mean_reversion(d, 20, 1.0),
    "ofi": lambda d: S.ofi_mean_reversion(d, 1.0, 4, 20),
    "vol_target": lambda d: S.vol_target(S.buy_and_hold(d), 0.01, 20, 288),
    "features": lambda d: X.build_features(d, X.FeatureConfig(include_multi_timeframe=True)),
    "volume_outliers": lambda d: Q.volume_outliers(d, window=20, z_threshold=1.5),
    "return_outliers": lambda d: Q.return_outliers(d, window=20, z_threshold=1.5),
    "backtest": lambda d: K.run_backtest(S.ma_crossover(d, 5, 20), K.BacktestConfig(execution="next_close")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_past_does_not_see_the_future(pair, name):
    before = F.col("ts") < F.lit(f.times(CUT + 1)[CUT])
    a, b = (OPERATORS[name](d).where(before).orderBy("ts").toPandas() for d in pair)
    assert len(a) > 0 and a.equals(b)
