"""The live form."""
