"""Operators over texts measured in tokens; nothing outside this subpackage imports it."""
