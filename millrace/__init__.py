"""A small analytics engine on Spark: single-table SQL with its own result rules, ingest, key routing, workflow reports."""
