"""Training-data operators: the ten corpus operators, their queries and their oracle SQL."""
