"""Document-conversion quality, validation and audit analytics on Spark."""
