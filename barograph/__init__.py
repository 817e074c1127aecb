"""Time-series research on Spark: ticks to bars, indicators, signals, fills, metrics, sweeps and validation."""
