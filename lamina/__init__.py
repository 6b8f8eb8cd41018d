"""lamina: document-corpus operators for PySpark.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``).
Python runs only where an operator is sequential by nature (greedy packing,
binary extraction, external providers), and then over Arrow batches.
"""

__version__ = "0.1.0"
