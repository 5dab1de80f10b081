"""Event-delivery tables on Spark: polling, claiming, transitions, routing, purge."""
