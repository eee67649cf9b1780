"""flowlens: network-flow analytics on PySpark."""
