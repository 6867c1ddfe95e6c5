"""Log-to-knowledge analytics on Spark.

Log text is assembled into entries, parsed, and routed: typed JSON records are
merged by key into Parquet tables, free text is embedded and upserted into
vector tables. Everything is a DataFrame-to-DataFrame function; only the sinks
in ``sources.tables`` and ``plans`` run jobs that write.
"""

from annalist.specs import EntitySpec, FieldSpec, Registry, text_entry

__all__ = ["EntitySpec", "FieldSpec", "Registry", "text_entry"]
