"""Jobs: operators and stored tables put together."""
