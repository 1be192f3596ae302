"""pruefwerk: Spark-native analytics for building and evaluating retrieval-augmented answering.

The package is organised by what a Spark user composes:

``sources``    readers and writers for the tables and review files
``functions``  Column -> Column functions and a few numeric tail probabilities
``operators``  DataFrame -> DataFrame operators (chunking, retrieval, alignment, scoring, statistics)
``plans``      the registered queries and their SQL counterparts
``streaming``  Structured Streaming over the call log
``llm``        operators for training-data pipelines; nothing else imports it
"""

__version__ = "0.1.0"
