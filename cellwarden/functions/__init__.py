"""Column expressions: text, dates, similarity, evidence masses and the gate."""
