"""Evidence, network and money-flow analytics as DataFrame-to-DataFrame functions on Spark."""
