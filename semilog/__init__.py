"""Semiring Datalog and corpus operators on PySpark."""
