"""tarnwood: workflow, catalogue and corpus analytics expressed as Spark DataFrame jobs."""
