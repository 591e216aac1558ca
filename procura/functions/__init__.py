"""Column functions: text, cells, URLs, prompts and model responses."""
