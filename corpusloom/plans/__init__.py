"""Planning on the driver: configurations, batch sizes, lineage."""
