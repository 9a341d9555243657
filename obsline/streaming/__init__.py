"""streaming of the observation engine."""
