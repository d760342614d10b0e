"""poolwise: near-optimal pooling of factorial data on Spark.

Facts carry a few discrete factor levels and a numeric outcome.  They are read
once into cell moments; everything after that (enumerating poolings, scoring
them, keeping all near-optimal ones, summarising the kept set) is a DataFrame
job over tables whose size depends on the design and not on the facts.
"""

from poolwise.spec import FactorSpec

__all__ = ["FactorSpec"]
