"""Column expressions: normalising, tokenising, language and value rules."""
