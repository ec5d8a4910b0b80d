"""Spark operators for the data work behind systematic literature reviews.

Every operator takes DataFrames and returns DataFrames, so a review of a
thousand records and one of a full bibliographic corpus run the same plan.
"""

__version__ = "0.1.0"
