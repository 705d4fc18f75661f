"""Log and status event analytics over many jobs, expressed as Spark jobs."""

__version__ = "0.1.0"
