"""Operators for building text training corpora. Nothing outside this subpackage imports it."""
