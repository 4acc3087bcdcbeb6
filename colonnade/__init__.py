"""Automated tabular analytics as Spark jobs: ingest, profile, explore, prepare, train, evaluate, explain."""
