"""Walk-forward forecast evaluation and corpus preparation as Spark DataFrame jobs."""
