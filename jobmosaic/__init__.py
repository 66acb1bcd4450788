"""Job-posting analytics as Spark jobs: every operator takes and returns DataFrames or builds columns."""
