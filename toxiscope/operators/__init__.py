"""Relational operators: sampling, profiling, features, models, evaluation."""
