"""vigilday: unusual user-days in activity logs, written as Spark DataFrame jobs."""
