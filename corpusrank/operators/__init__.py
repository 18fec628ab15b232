"""Relational operators: the link graph, mention scoring, and the entity store."""
