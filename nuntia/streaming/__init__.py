"""The stateless operators in Structured Streaming."""
