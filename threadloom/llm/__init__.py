"""Operators that prepare mail text as training data; nothing outside this folder imports it."""
