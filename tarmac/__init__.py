"""tarmac: on-time flight analytics on Spark.

Cleaning, calendar/distance/category features, Spark ML delay classifiers,
batch and streaming scoring with risk and confidence bands, and drift
monitoring of the prediction log — all as DataFrame plans.
"""

__version__ = "0.1.0"
