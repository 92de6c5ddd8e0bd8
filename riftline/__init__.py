"""riftline: change-risk analytics over source files, diffs and reviewer verdicts, as Spark jobs."""
