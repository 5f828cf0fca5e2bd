"""pagemill: document reflow and reading analytics as Spark DataFrame plans."""
