"""Spark-first analytics over assistant memory: retrieval, extraction, upkeep and observation."""
