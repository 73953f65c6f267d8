"""Relational operators with the engine's semantics, as DataFrame compositions."""
