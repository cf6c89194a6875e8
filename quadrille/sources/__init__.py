"""Where quads come from."""
