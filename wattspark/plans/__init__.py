"""Registered queries over the driver tables.

``views``   - telemetry-shaped frames derived from the driver tables (SURVEY 7.2)
``queries`` - one function per operator ID, ``(spark, sf_dir) -> DataFrame``
``oracle``  - independent DuckDB SQL for each query, for the correctness gate
"""
