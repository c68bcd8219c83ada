"""Composed jobs: the labelled-corpus chain and the query catalog."""
