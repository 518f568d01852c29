"""Questions over the graph, entity pipelines, and the mapping of test tables to a graph."""
