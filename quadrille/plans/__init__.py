"""Configuration, the fragmenter, the command line, and working tables."""
