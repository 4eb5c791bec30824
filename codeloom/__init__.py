"""codeloom: a PySpark engine that turns source repositories into a queryable knowledge graph."""
