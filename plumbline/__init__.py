"""Item-level measurement audits and corpus preparation as Spark jobs."""
