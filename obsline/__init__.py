"""obsline: analytics over noisy observation streams, written as Spark DataFrame operators."""
