"""Column functions: text, identity, dates, vectors and scores."""
