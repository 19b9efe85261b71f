"""The reports: each is a function of an enriched event table and its parameters."""
