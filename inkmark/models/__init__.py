"""Training and scoring jobs on Spark ML."""
