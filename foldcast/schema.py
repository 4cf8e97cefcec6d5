"""Column contracts of the library's tables."""

from pyspark.sql import types as T

_D, _S, _F, _I = T.DateType(), T.StringType(), T.DoubleType(), T.IntegerType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


PANEL = _schema(date=_D, asset=_S, open=_F, high=_F, low=_F, close=_F, volume=_F)
PRICES = ("open", "high", "low", "close")
WINDOWS, TREND = (5, 21), 63
OWN_FEATURES = ("ret", "ret_lag", *(f"{x}_{s}_{w}" for w in WINDOWS for x in ("ret", "vol") for s in ("mean", "std")))
REF_FEATURES = ("ref_ret", "ref_ret_lag", *(f"ref_{s}_{w}" for w in WINDOWS for s in ("mean", "std")), f"ref_trend_{TREND}")
FEATURES = (*OWN_FEATURES, *REF_FEATURES)
SAMPLE_KEY = ("asset", "origin_date", "target_date")
FORECAST_KEY = ("fold", "asset", "origin_date", "target_date")
#: What a forecast is of, what it says, the regimes it fell in, and the run that made it.
FORECAST = _schema(
    model=_S, config=_S, seed=_S, fold=_S, partition=_S, asset=_S, origin_date=_D, target_date=_D,
    predicted_return=_F, actual_return=_F, predicted_direction=_I, actual_direction=_I,
    trend_regime=_S, volatility_regime=_S, transition_regime=_S, run_id=_S,
)
REFERENCE = "MKT"
DIMENSIONS = {"trend_regime": ("positive", "negative"), "volatility_regime": ("low", "high"), "transition_regime": ("stable", "stressed")}
