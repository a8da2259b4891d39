"""wortlaut: consistency checks over large XML dictionary corpora, as Spark jobs.

A corpus is shredded once into a table with one row per XML node; every check is a DataFrame query over that
table.  ``wortlaut.sources`` reads and writes, ``wortlaut.operators`` holds the checks, ``wortlaut.functions`` the
Column helpers they share, and ``wortlaut.plans`` the queries registered for the driver.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
