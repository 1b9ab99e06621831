"""Reading landed dumps and keeping the stored tables."""
