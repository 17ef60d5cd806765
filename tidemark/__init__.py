"""Consistency analytics for versioned, keyed data on Spark: state folds, freshness-qualified reads, change streams, verification, telemetry."""
