"""Graph jobs: ontology clean-up, projection, similarity, ranking, communities."""
