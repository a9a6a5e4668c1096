"""Where history tables come from."""
