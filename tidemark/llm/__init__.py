"""Operators for training-data pipelines: dedup, decontamination, tokens, archives, classifiers, chat, shards."""
