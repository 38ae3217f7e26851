"""Column functions: text, numbers, hashes and switches."""
