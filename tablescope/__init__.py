"""tablescope: table profiling and exploration on Spark."""
