"""Column functions: text, keys and payloads, geometry, scores."""
