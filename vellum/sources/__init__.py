"""Sources and sinks: document folders, catalogues, stage tables, feedback."""
