"""binscore: Spark-native scoring and comparison of binary classifiers.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from
built-in Spark SQL expressions, so Catalyst can prune, push down and
fuse them into whole-stage code.  Sub-packages:

* ``sources``   - readers, sinks and the bindings to the driver tables
* ``functions`` - column expressions (text normalisation, parsing, prompts)
* ``operators`` - joins, aggregations, ranks, statistics, reshapes, learners
* ``plans``     - end-to-end plans (inference, analysis, evaluation) and the
                  query registry used by ``__spark_entry__``
* ``streaming`` - incremental (restartable) scoring on Structured Streaming
"""

from binscore.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
