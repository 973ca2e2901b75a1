"""Column expressions: fields, text, digest lines, prompts."""
