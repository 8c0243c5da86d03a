"""The row-wise detectors and quality metrics over Structured Streaming."""
