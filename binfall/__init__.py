"""Log-linear counts of values as DataFrame operators: bucketing, counting, merging, quantiles, conversions and streaming."""
