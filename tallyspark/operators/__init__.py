"""DataFrame-level operators: profiling, metrics, joins, entity store."""
