"""Event-tempo analytics on Spark: what changes in an event log between two periods."""
