"""Trial analytics on Spark: grading, replay, summaries and live views of recorded agent trials."""
