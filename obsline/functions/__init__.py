"""functions of the observation engine."""
