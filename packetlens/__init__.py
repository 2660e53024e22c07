"""packetlens: labelled network-traffic analytics expressed as Spark DataFrame plans.

Sub-packages
------------
functions  Column builders (IP arithmetic, ports, protocol/session keys, parsers).
operators  DataFrame -> DataFrame operators (schema, profile, sessions, sampling,
           encoding, metrics, feature-subset scoring).
sources    Readers and writers (CSV with overrides, labelled directories, parquet
           read-through cache, results sink).
plans      End-to-end compositions (dataset presets, preparation, experiment rows).
streaming  Incremental sessionization of packet streams.
"""

__version__ = "0.1.0"
