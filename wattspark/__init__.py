"""wattspark: data-centre telemetry analytics as Spark DataFrame plans.

Every public function takes and returns DataFrames and performs no action
(sinks excepted). Sub-packages:

* ``functions``  - column-level helpers (time arithmetic, null-safe maths)
* ``operators``  - DataFrame operators (energy, runs, range join, PUE, I/O, quality, reports)
* ``sources``    - scans and parsers for parquet lakes and text/JSON/CSV telemetry
* ``plans``      - the registered queries over the driver tables
* ``streaming``  - Structured Streaming ingest and stateful operators
"""

from wattspark.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
