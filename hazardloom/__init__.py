"""Risk screening of text-described entities as Spark DataFrame jobs."""
