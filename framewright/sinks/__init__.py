"""Files from frames."""
