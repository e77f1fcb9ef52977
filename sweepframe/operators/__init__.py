"""The radar operators, by domain."""
