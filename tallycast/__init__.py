"""Probabilistic demand forecasting over large panels of daily series, written as Spark DataFrame operators."""
