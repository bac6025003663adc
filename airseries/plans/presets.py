"""Feature presets used by the reference pipelines.

Fixed values (must equal the reference): lag sets, rolling window lengths,
calendar parts, target offsets (24/48/72 rows) and column names below.
"""

from airseries.operators.features import FeatureSpec

# Training preset: target alias, hour/day/month, three lags, two rolling
# means, three day-ahead targets, rows with any NULL dropped.
TRAINING = FeatureSpec(
    source="pm2_5", alias="aqi_pm25",
    lags=(1, 3, 6), lag_name="lag_{k}",
    roll_mean=(6, 12), roll_mean_name="roll_mean_{n}",
    calendar=("hour", "day", "month"),
    targets=(("target_h1", 24), ("target_h2", 48), ("target_h3", 72)),
    dropna=True,
)

# Shared training/inference build: same features, no targets, no NULL drop.
FINAL = TRAINING.with_(targets=(), dropna=False)

# Wide preset: five lags and three rolling means of pm2_5, hour and weekday.
WIDE = FeatureSpec(
    source="pm2_5",
    lags=(1, 3, 6, 12, 24), roll_mean=(6, 12, 24),
    calendar=("hour", "day_of_week"),
    targets=(("target_h1", 24), ("target_h2", 48), ("target_h3", 72)),
    dropna=True,
)

# Inference-time lag/rolling set (long lags, rolling mean and std).
INFERENCE = FeatureSpec(
    source="pm2_5",
    lags=(1, 6, 12, 24, 48, 72, 168),
    roll_mean=(6, 12, 24, 48), roll_std=(6, 12, 24, 48),
    calendar=("hour", "day", "month", "dayofweek"),
)

# Eight-column model input of the training preset.
TRAINING_FEATURES = ["hour", "day", "month", "lag_1", "lag_3", "lag_6",
                     "roll_mean_6", "roll_mean_12"]
TARGETS = ["target_h1", "target_h2", "target_h3"]
