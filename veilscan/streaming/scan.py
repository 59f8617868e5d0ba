"""The scan on streaming records. Detection is row-wise and keeps no state, so it needs no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.config import ScanSpec
from ..plans.scan import find_in_records


def stream_findings(records: DataFrame, spec: ScanSpec, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append the findings of arriving records to a dataset; stops when the available input is used up."""
    writer = find_in_records(records, spec).writeStream.format(fmt).outputMode("append")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
