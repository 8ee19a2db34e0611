"""Training-data operators at corpus scale.

Nothing outside this subpackage imports it.  The functions that run on executors are shipped by value, so a cluster
needs the third-party libraries but no copy of this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
