"""Play events as Structured Streaming."""
