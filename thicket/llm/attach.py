"""Columns that a function of whole texts adds, with the documents' own columns carried beside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def attach(docs: DataFrame, carry: list[str], make: Callable[[], Callable[[pa.Array], dict[str, list | pa.Array]]], result: str) -> DataFrame:
    """(row, found): the carried columns as a struct, and a struct of what was found in the text.

    make() runs once in a task and gives the function from a column of texts to the found columns.
    Nothing clashes with a column of docs, and nothing is shuffled.
    """
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col("text"))
    found = T._parse_datatype_string(result)
    kinds = {f.name: to_arrow_type(f.dataType) for f in found.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            got = function(batch.column("text"))
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, kinds[name]) for name, x in ((name, got[name]) for name in kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.StructArray.from_arrays(arrays, names=list(kinds))], names=["row", "found"])

    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("found", found)]))
