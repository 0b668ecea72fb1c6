"""Whole operators: joins, aggregates, folds and rankings over shots, films and photos."""
