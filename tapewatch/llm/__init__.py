"""Operators that prepare training text: archives, personal data, quality, tokens, duplicates, leaks, secrets."""
