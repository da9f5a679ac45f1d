"""Sources and sinks: tables, time slices, streams, counter stores, SQL views."""
