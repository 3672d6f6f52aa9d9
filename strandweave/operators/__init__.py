"""DataFrame operators. Every function takes frames and parameters and returns a lazy frame."""
