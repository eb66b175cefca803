"""Where policies and texts come from, and where results go."""
