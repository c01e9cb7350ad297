"""The event mirror as Structured Streaming."""
