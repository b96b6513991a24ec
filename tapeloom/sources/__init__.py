"""Reading, merging and writing market-data tables."""
