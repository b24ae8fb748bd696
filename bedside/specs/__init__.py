"""Code dictionaries and score tables as plain data."""
