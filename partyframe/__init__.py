"""partyframe: PySpark toolkit for tables whose columns are split between parties.

Everything is a plain function from DataFrame to DataFrame (or to a small,
size-checked Python value such as a fitted dictionary).  Sub-packages:

* ``sources``   - readers / writers (CSV, party layout, messages, logs)
* ``functions`` - Column-expression helpers (activations, fp16 grid, bit widths)
* ``operators`` - prep, index, align, codec, model, fit, compress, evaluate
* ``plans``     - the reference's entries as calls (``prepare``, ``datasets``, ``experiment``)
                  and the registered queries over the test tables
* ``streaming`` - incremental monitoring of metric logs (best epoch / early stop)
"""

from partyframe.session import get_spark, ensure_checkpoint_dir  # noqa: F401

import sys as _sys  # noqa: E402

from pyspark import cloudpickle as _cloudpickle  # noqa: E402

# Functions of this package that run in tasks travel with the job, so workers need no copy of it on their path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
