"""Column functions: RDF terms, text with the regular expressions and IRIs of the configuration language, hashes."""
