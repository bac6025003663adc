"""Results do not depend on the input partitioning."""

from airseries.operators import eda as E
from airseries.operators import features as W
from airseries.operators import metrics as M
from airseries.operators import quality as Q
from airseries.operators import registry as R
from airseries.plans import fixtures as fx
from airseries.plans.presets import WIDE
from tests.conftest import SF


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_unchanged_after_repartition(spark):
    r = fx.readings(spark, SF["0.01"])
    shuffled = r.repartition(17, "datetime")
    ops = [
        lambda d: W.build_features(d, WIDE.with_(digits=6)),
        lambda d: W.build_features(d, WIDE.with_(digits=6), chunk_rows=64),
        lambda d: Q.gap_report(d),
        lambda d: E.histogram(d, "pm2_5", 50),
        lambda d: E.corr_matrix(d, ["pm2_5", "pm10", "nitrogen_dioxide"], digits=9),
        lambda d: E.group_means(d.withColumn("h", d["datetime"].cast("string").substr(12, 2)), "h",
                                ["pm2_5", "pm10"], decimals=2),
        lambda d: M.regression_metrics(d.withColumnRenamed("pm2_5", "y").withColumnRenamed("pm10", "p"),
                                       by="series_id", digits=9),
        lambda d: W.latest_rows(d),
    ]
    for op in ops:
        assert _rows(op(r)) == _rows(op(shuffled))
    reg = fx.registry(spark, SF["0.01"]).drop("features")
    assert _rows(R.promote_best(reg)) == _rows(R.promote_best(reg.repartition(7)))
