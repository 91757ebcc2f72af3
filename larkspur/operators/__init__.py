"""DataFrame operators behind the dialect."""
