"""Operators for text used to train language models; nothing outside this subpackage imports it."""
