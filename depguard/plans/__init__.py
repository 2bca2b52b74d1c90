"""Physical strategies shared by the operators: skew handling, pair joins, rule scheduling."""
