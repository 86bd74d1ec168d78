"""Column expressions: small functions over ``Column``, never row UDFs."""
