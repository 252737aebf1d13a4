"""The test workload: model tables derived from the driver's tables, queries and their SQL."""
