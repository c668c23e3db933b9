"""Web-corpus preparation as Spark DataFrame transformations.

Sub-packages
------------
functions   Column -> Column building blocks (URLs, HTML, text, n-grams)
operators   DataFrame -> DataFrame transformations
sources     readers for specifications, captured pages, paragraph CSVs, raw files
sinks       writers for the same, and result messages
streaming   Structured Streaming jobs around the same operators
plans       whole jobs: the crawl plan, derived fixtures, the query catalogue
"""

__version__ = "0.1.0"
