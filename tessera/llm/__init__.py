"""Operators of a training-data pipeline: dedup, tokenising, scoring, mixing. Nothing else imports this package."""
