"""Column-expression functions (no UDFs): AQI, categories, calendar, transforms."""

from airseries.functions.aqi import (aqi_pm25, add_aqi_column, classify_aqi,
                                     classify_aqi_5, advisory)
from airseries.functions.calendar import (add_time_features, calendar_parts,
                                          cyclical, hour_floor)
from airseries.functions.transforms import (add_interactions, inverse_log,
                                            round_prediction, forecast_date,
                                            model_version, version_stamp,
                                            strength_flag)

__all__ = [
    "aqi_pm25", "add_aqi_column", "classify_aqi", "classify_aqi_5", "advisory",
    "add_time_features", "calendar_parts", "cyclical", "hour_floor",
    "add_interactions", "inverse_log", "round_prediction", "forecast_date",
    "model_version", "version_stamp", "strength_flag",
]
