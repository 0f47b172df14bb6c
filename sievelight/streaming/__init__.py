"""Incremental scoring: the batch operator and its streaming form."""
