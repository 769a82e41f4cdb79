"""Operators of the language-model kind; nothing outside this subpackage imports it."""
