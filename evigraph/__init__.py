"""Evidence-graph analytics on Spark: documents, entity mentions, co-occurrence graphs and the questions asked of them."""
