"""Agent-memory analytics on Spark: retrieval, consolidation, scheduling and corpus operators as DataFrame jobs."""
