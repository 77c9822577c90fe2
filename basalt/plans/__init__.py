"""Plans: the queries that the engine registers."""
