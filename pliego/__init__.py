"""pliego — procurement-contract analytics as Spark DataFrame operators.

Sub-packages:
  functions/  Column -> Column scalar expressions (text, money, dates, links)
  operators/  DataFrame -> DataFrame operators (cleaning, filters, lookups,
              unification, study statistics, quality checks, paging)
  sources/    landed-file scans and sinks, HTML extraction
  plans/      composite jobs and the contract view over the test tables
  streaming/  incremental keyed base (batch and Structured Streaming)
"""

__version__ = "0.1.0"
