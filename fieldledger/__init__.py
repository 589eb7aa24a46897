"""Field-operations analytics on Spark: dashboards, work queues, rankings and write rules."""
