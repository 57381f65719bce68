"""screenlake: set-level analytics over screenshots and documents, on Spark."""
