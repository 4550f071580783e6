"""Query plans over the driver tables: stand-in inputs, registered queries, oracle SQL."""
