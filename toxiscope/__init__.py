"""toxiscope: labelled-text analytics on Spark.

Cleaning, exact stratified splits, TF-IDF features, relational Naive Bayes,
MLlib baselines, batch/stream scoring and per-split / per-language
evaluation, all expressed as DataFrame jobs.
"""

__version__ = "0.1.0"
