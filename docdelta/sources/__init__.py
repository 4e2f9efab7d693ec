"""Table, object and stream sources."""
