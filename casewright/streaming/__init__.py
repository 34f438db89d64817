"""Continuous forms of the counters and ladders; each gives what its batch form gives."""
