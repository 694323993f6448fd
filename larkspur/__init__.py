"""Analytics, geometry and time-series operators on PySpark DataFrames."""
