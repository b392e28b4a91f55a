"""Particle-history analytics as Spark DataFrame jobs.

Tables of particles at successive snapshots, catalogues of the halos and galaxies they sit in, and event
logs (wind launches, rejoins, splits) go in as DataFrames; every operator returns a lazy DataFrame.
"""
