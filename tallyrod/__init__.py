"""Spark operators that score texts, apply rules kept as tables and measure how far labels can be trusted."""
