"""Table, CSV and file sources and sinks."""
