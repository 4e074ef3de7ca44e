"""Kinetic and thermodynamic analysis of ordered trajectories as Spark DataFrame plans."""
