"""Sources and sinks: gzip files as a Python Data Source."""
