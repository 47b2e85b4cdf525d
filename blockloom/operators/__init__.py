"""DataFrame operators: chunks, encode, decode, listing, verdicts."""
