"""Clinical relations composed from the operators, each a function from frames to a frame."""
