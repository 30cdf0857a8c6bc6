"""Column functions: token arrays, tokenizers and scalars, all inside Catalyst."""
