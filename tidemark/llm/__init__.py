"""Operators of a large-scale training-data pipeline.

Nothing outside this package (and ``corpus_pipeline.py``) imports it. Functions
that run in Python workers travel by value, so executors need no install.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
