"""Operators for training-data pipelines, one module per problem."""
