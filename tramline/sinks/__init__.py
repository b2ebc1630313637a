"""Tables and files out."""
