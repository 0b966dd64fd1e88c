"""Web analytics on Spark: hits, visits, metrics, breakdowns and reports."""
