"""framesift: refine image sets for training with Spark DataFrame jobs."""
