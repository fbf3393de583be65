"""Declared plans: bindings of tables, projections of the log, fixed queries, the query catalogue."""
