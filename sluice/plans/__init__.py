"""The pipe language: text to syntax tree to DataFrame."""
