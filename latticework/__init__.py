"""Frame curation and detection-evaluation jobs on Spark."""
