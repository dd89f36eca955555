"""Training-data operators: filters, near copies, search, tokens, formats and small models over text tables."""
