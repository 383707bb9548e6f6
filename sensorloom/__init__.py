"""Telemetry processing as Spark jobs: raw observations in, audited canonical samples out."""
