"""A Spark-first engine that finds, masks and restores personal data in text columns."""
