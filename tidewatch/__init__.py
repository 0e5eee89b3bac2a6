"""Causal forecast evaluation over many time series, written as Spark jobs."""
