"""Records from noisy one-line entries: reading, converting, checking, scoring and generating them with Spark."""
