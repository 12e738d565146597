"""tabshift: converting, profiling and scoring semi-structured files on Spark."""
