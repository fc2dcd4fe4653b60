"""Spark jobs for panels of daily prices: cleaning, features, backtests, calibration, scoring, serving."""
