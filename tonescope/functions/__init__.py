"""Column builders: text, lexicons, technique rules, tokenization."""
