"""Column expressions: text clean-up, label encoders, stylometry, n-grams."""
