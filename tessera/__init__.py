"""tessera: hierarchical probabilistic clustering of multi-subject maps on Spark.

Data live in DataFrames with one row per (dataset, subject, location); model
parameters are small driver-side arrays, except per-location priors, which stay
in DataFrames.  See README.md for the tour.
"""

__all__ = ["functions", "operators", "sources", "plans", "streaming"]
