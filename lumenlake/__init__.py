"""Media-catalogue analytics on Spark: cataloguing, duplicate detection,
retention planning, re-layout planning and progress reporting."""
