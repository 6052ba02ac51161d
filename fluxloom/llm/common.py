"""What the operators of this subpackage share: sessions, shared folders, Arrow plumbing.

Input convention: every operator takes a DataFrame and the names of its id and
text columns and selects those first, so extra columns, whatever their names,
never clash.  A null text counts as empty unless an operator says otherwise; a
null id is kept and returned as null.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

# The libraries' own thread pools would oversubscribe an executor's cores.
os.environ.setdefault("RAYON_NUM_THREADS", "1")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.session import ship
from fluxloom.shared import drop, folder, scratch, written  # noqa: F401  (intermediate tables of the operators)

#: Rows in one Arrow batch: with texts of some MB a batch stays far below a Python worker's memory.
ARROW_ROWS = 512
#: Bytes in one Arrow batch, the second bound.
ARROW_BYTES = 32 << 20


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and make the package importable in Python workers.

    The bounds stay set in the session: plans are lazy, so they must hold when an
    action runs, and a caller's smaller bound is kept.
    """
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    ship(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def with_places(df: DataFrame) -> bool:
    """Whether df is a table of Parquet files as it stands, so that a row's file and position in it name the row."""
    try:
        df.select(df.metadataColumn("_metadata").getField("row_index"))
    except AnalysisException:
        return False
    return df._jdf.queryExecution().analyzed().children().isEmpty()


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text alone, null text as empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def by_batch(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """df through a function of columns (lists in, lists or arrays out).

    make runs once in each Python worker task and loads what the function needs there.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    prepare(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            out = f({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            if out is not None and len(next(iter(out.values()))):
                yield pa.RecordBatch.from_arrays([pa.array(out[t.name], t.type) for t in target], schema=target)

    return df.mapInArrow(run, schema)
