"""sources of the observation engine."""
