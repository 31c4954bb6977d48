"""Column builders: stable keys, text and path rules, array and signal expressions, content hashes."""
