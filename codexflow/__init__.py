"""codexflow: document-corpus analytics on Spark.

Every public function maps a DataFrame to a DataFrame or a Column to a Column.
A document is one row; lines, sections and chunks are arrays inside that row
until they are exploded, so structural work needs no shuffle.
"""

__version__ = "0.1.0"
