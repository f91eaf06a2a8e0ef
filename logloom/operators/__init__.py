"""DataFrame-level operators: parsing/normalisation of raw logs and the summary queries."""
