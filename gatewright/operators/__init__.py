"""Rank, check, recover, abstain and evaluate, as DataFrame transformations."""
