"""Sources and sinks: explicit-schema table scans, CSV/text files, table replacement."""
