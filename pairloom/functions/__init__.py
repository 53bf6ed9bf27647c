"""Column functions: text normalisation, tokenizers, rules and similarities."""
