"""Symbols and relations out of source text, one parser a language."""
