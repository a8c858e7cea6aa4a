"""chronoweave: bi-temporal fact graphs and transcript data on Spark."""
