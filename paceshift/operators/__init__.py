"""DataFrame-to-DataFrame operators that take column names, so they run on any event table."""
