"""shopgroups: retail shopper segmentation and basket analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames, carries the customer
key, and leaves physical planning to Catalyst and AQE.
"""

__version__ = "0.1.0"
