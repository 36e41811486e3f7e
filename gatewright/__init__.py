"""A decision engine for tool calls, as queries over Spark tables."""
