"""DataFrame -> DataFrame operators, one module per application family."""
