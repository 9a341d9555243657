"""operators of the observation engine."""
