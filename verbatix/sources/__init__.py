"""Sources and sinks: catalog, raw files, pages, HTML, corpus tables."""
