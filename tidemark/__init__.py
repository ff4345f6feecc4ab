"""Price and volume time-series analytics on Spark DataFrames keyed by (symbol, date)."""
