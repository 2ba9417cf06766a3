"""Evidence-aware anomaly analytics over time-indexed telemetry, written as Spark jobs."""
