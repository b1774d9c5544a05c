"""Named query plans: each registered query is a composition of operators
over the given tables, with an SQL twin for the oracle check."""
