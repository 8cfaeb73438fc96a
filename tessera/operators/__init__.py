"""Operators on any table: joins, windows, folds, reliability, resampling, models."""
