"""Snapshot reconciliation, DAG analytics and corpus preparation on Spark."""
