"""Bars, microstructure, order book, signals, backtests, statistics, quality, features, models."""
