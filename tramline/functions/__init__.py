"""Expressions that several plans share, as SQL text."""
