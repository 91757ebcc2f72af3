"""From SQL text to a DataFrame."""
