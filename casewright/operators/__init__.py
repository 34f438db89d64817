"""Distributed operators over cases, experiences and trajectories."""
