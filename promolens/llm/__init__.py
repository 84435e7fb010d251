"""Corpus operators for training-data pipelines; self-contained, nothing else imports it."""
