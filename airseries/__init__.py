"""airseries: hourly sensor-series features, reports, registry and forecasts on Spark.

Every operator takes and returns a ``pyspark.sql.DataFrame``. Scalar
functions return ``Column`` expressions so they stay inside whole-stage
codegen and also work on streaming DataFrames.
"""

__version__ = "0.1.0"
