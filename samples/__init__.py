"""Queries on the driver's tables: each one feeds an operator of the library from those tables and has,
where SQL can say it, a second definition in SQL that knows nothing of the library's expressions."""
