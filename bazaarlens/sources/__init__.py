"""Readers for the logical tables, and the mapping of the benchmark star schema onto them."""
