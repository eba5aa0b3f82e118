"""Record linkage and master-data maintenance over tabular listings, as Spark plans."""
