"""Customer, retail, market and campaign analytics expressed as Spark DataFrame jobs."""
