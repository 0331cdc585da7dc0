"""Relatedness and pedigree analytics as Spark jobs."""
