"""Reading assessment tables and writing results."""
