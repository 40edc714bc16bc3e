"""Training-data operators: extraction, deduplication, scoring, mixing, packing, chat formatting.

Nothing outside this subpackage imports it. Scratch tables go to the shared folder named by
``spark.checkpoint.dir`` (see :mod:`strandflow.llm.common`).
"""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
