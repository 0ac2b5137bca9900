"""Column expressions: text in ``text``, arrays in ``nested``."""
