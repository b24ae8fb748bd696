"""Dataset-level operators, parameterised by column names."""
