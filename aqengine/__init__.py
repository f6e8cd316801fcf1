"""Air-quality analytics on Spark: DataFrame functions for feeds, windows, alerts, archives and serving queries."""
