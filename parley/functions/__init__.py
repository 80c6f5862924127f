"""Column expressions: text, phonetic keys, vectors, time labels."""
