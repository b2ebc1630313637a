"""The conflict stage over a stream."""
