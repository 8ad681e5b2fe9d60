"""Food and recipe analytics, expressed as Spark DataFrame transformations."""
