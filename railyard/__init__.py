"""Schedule-to-flow analytics on Spark: feeds, graphs, Markov chains, demand, resilience, scenarios."""
