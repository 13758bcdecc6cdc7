"""Schema-corpus analytics on Spark: catalogs, vocabularies, retrieval, augmentation, scoring."""
