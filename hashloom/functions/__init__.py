"""Column expressions: hashing, n-grams, preprocessing, vector algebra, reduction."""
