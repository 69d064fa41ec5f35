"""Training-data operators: quality, dedup, tokens, fingerprints, scoring, mixing.

Nothing else in the library imports this package.  Task functions are shipped
to executors by value, so a cluster needs only the public libraries there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
