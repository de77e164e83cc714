"""Operators for preparing training data, all on whole documents."""
