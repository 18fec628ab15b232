"""corpusrank: link-graph, wikitext and corpus analytics on PySpark."""
