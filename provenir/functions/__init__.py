"""Column expressions: URLs, hosts, text, identifiers."""
