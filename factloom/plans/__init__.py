"""Plans of the evidence engine."""
