"""Review retrieval and place ranking as Spark DataFrame jobs."""
