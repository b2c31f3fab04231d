"""A key for every row, the same whenever the rows are read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from adjudica.sources.scratch import materialise

ROW = "__row"
DOC = "__doc"


def _is_plain_read(docs: DataFrame) -> bool:
    """Whether ``docs`` reads files and neither multiplies nor merges their rows."""
    if "_metadata" in docs.columns:
        return False
    nodes = docs._jdf.queryExecution().analyzed().toString().splitlines()
    return bool(docs.inputFiles()) and all(
        re.match(r"[\s:+-]*(Relation|Project|Filter|SubqueryAlias)\b", node) for node in nodes if node.strip()
    )


def keyed(docs: DataFrame) -> DataFrame:
    """__row, __doc: a key of two numbers and the row's own columns as a struct.

    Rows of a plain read of files are known by file and place in it. Those of any other frame are
    numbered and stored once, as a second evaluation could number them differently.
    """
    everything = F.struct("*").alias(DOC)
    if _is_plain_read(docs):
        place = F.struct(
            F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("index")
        )
        return docs.select(place.alias(ROW), everything)
    place = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("index"))
    return materialise(docs.select(place.alias(ROW), everything), "numbered")
