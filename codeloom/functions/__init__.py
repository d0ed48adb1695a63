"""Functions that run on executors."""
