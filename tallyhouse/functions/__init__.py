"""Column helpers shared by the plans."""
