"""docquarry: document analytics and ranked search as PySpark jobs."""

__version__ = "0.1.0"
