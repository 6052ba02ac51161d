"""A PySpark engine for reaction-network analytics and training-data pipelines."""
