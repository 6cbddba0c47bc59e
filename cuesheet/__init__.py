"""cuesheet: timeline text to clean, numbered track lists, as Spark jobs."""
