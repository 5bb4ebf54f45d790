"""Tessera: an analytics engine on Spark DataFrames and Spark SQL, with PostgreSQL-flavoured functions and operators."""
