"""Importing this module registers every query of the library."""

from lumenfold.plans import estimator_queries, format_queries, image_queries, kernel_queries, map_queries, math_queries, particle_queries  # noqa: F401
