"""Operators that turn raw text corpora into training data. Nothing outside this subpackage imports it."""
