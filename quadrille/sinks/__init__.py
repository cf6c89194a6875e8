"""Where quads go."""
