"""Customer-account analytics as Spark jobs: ingest, marts, metrics, actions, search."""
