"""Scoring of event tensors by given weights, and what is read from the scores."""
