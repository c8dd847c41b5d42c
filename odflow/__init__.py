"""Survey-flow analytics on Spark: weighted origin-destination statistics from household samples."""
