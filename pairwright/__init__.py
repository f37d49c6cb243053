"""pairwright: record linkage and corpus preparation as Spark plans."""
