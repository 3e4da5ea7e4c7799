"""Operators: evidence, emissions, priors, inference, learning, evaluation."""
