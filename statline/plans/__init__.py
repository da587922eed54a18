"""Reports that combine several jobs."""
