"""Text, timeline and table analytics expressed as Spark DataFrame jobs."""
