"""Column functions: text, hashing, probability."""
