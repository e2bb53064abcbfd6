"""Security-aware analytics on Spark: labelled records, timelines, telemetry, topology, text and vectors."""
