"""Relational operators: each takes frames and gives a lazy frame, with its order made explicit by columns."""
