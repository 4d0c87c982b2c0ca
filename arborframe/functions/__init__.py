"""Losses, transforms and metrics as expressions and aggregates."""
