"""Part of the plinth engine."""
