"""postingflow: job-posting ingestion, matching, merging and search as Spark DataFrame operators."""
