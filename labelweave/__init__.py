"""labelweave: cost-aware ensemble labelling and event-graph analytics as Spark jobs."""
