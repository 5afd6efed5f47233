"""Sources and sinks: parquet tables, the domain view of the test tables, artifacts, exports."""
