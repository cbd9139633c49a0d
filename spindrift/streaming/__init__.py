"""Live counterparts with Structured Streaming."""
