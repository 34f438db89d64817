"""Column expressions: text normalisation, classification, scoring."""
