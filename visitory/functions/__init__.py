"""Column functions: text, user agents, time."""
