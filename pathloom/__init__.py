"""Raw map elements to routable path networks, and analysis of routes over them, on Spark."""
