"""Community analytics on graphs, as DataFrame jobs."""
