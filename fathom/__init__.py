"""fathom: event analytics on Spark.

Four families of DataFrame -> DataFrame operators, all built on Spark SQL,
Structured Streaming and Spark ML:

* ``fathom.operators.weblog``    web-log hits, page views and bounce counts
* ``fathom.operators.facts``     packet facts, dimension keys, categorisation, fan-out
* ``fathom.operators.series``    bucket counts, zero-filled grids, sliding top-N
* ``fathom.operators.anomaly``   trailing-window anomaly rule and its queries
* ``fathom.operators.text``      text normalisation, tokens, Naive Bayes sentiment
* ``fathom.operators.recommend`` ALS recommendations without driver loops

``fathom.streaming`` runs the same functions on streaming frames.
"""

__version__ = "0.1.0"
