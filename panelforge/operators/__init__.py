"""Metrics, admission, combination and backtests over factor values in long form."""
