"""Plans: configured runs of the operators, the views that queries run on, and the queries."""
