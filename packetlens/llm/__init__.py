"""Training-data operators: dedup, sharding, token output, mixing, decontamination, PII, chat, quality, licences.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its
queries when it is present.
"""

import sys

from pyspark import cloudpickle

# functions that tasks call travel with the task: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
