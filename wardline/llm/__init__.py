"""Operators for training data: one module each, with its registered query; shared helpers in `common`."""
