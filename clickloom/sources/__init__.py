"""Where events come from and where tables go."""
