"""Market-data analytics on Spark: ticks, bars, indicators, rules, labels, statistics, streams."""
