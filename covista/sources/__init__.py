"""Table, text, JDBC sources and file sinks of the job, plus fixture views over the driver tables."""
