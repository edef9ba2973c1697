"""Property graphs of software architecture, and corpus preparation, on Spark."""
