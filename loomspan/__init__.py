"""loomspan: session analytics expressed as Spark DataFrame jobs."""
