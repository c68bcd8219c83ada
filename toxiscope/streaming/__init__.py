"""Scoring of unlabelled text in batch and as a Structured Streaming job."""

from toxiscope.streaming.scoring import (  # noqa: F401
    score_texts, score_comments, nb_batch_scorer, score_with_udf, score_stream,
)
