"""Registry-landscape analytics on Spark: ingest, resolve, view, serve, evaluate."""
