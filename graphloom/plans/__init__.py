"""How iterative operators run, and the same iterations as one SQL statement."""
