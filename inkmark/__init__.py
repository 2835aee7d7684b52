"""Spark jobs that clean, audit, split, featurise and classify labelled text corpora."""
