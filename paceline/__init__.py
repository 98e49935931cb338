"""paceline: analytics over personal time series, written for Spark DataFrames."""
