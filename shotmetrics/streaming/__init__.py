"""Incremental filling of the stored tables."""
