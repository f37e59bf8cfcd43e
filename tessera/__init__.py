"""Tessera: a Spark-first engine for curating and scoring text datasets."""
