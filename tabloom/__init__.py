"""A Spark-native engine for business-table analytics."""

import sys

from pyspark import cloudpickle

# Workers need not have the package installed: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
