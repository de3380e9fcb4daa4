"""Operators of a training-data pipeline: deduplication, decontamination, scoring, tokenizers. Nothing outside imports this folder."""
