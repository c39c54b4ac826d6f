"""DataFrame-to-DataFrame operators, one module per operator family."""
