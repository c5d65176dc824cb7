"""gleaner: literature-triage analytics as Spark jobs.

Every public function takes and returns DataFrames or Columns, so that a
caller composes them into one plan and leaves the physical strategy to Spark.
"""
