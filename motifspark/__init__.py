"""Tandem-repeat motif discovery and corpus preparation as Spark jobs."""
