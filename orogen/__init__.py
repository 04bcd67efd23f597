"""Analytics of event-sourced tectonic-plate data on Spark."""
