"""Column expressions, and the encoder hook."""
