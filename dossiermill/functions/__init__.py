"""Column functions: chemistry, evidence, language, text, scoring and JSON trees."""
