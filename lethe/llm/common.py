"""What the operators of this subpackage share: row keys, written intermediates, prefix sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.session import new_dir, ship_package

# White space of the contracts: space, tab, line feed, vertical tab, form feed, return.
WHITE = r"\x20\x09-\x0D"

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write an intermediate to the shared folder and read it back: lineage ends there."""
    path = new_dir(df.sparkSession, f"llm-{label}")
    df.write.partitionBy(*partition_by).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, keep_last: bool = False) -> Iterator[None]:
    """Delete the intermediates written inside on leaving, but for the last one if asked.

    For callers that write a result before they leave; a result not yet written needs them.
    """
    before = len(_written)
    whole = False
    try:
        yield
        whole = True
    finally:
        hadoop = spark._jsc.hadoopConfiguration()
        own = _written[before:]
        del _written[before:]
        # After an error there is no result to keep.
        for path in own[:-1] if keep_last and whole else own:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(hadoop).delete(folder, True)


# Rows of long texts are handed to Python in batches of about so many bytes and rows at most; the
# default of ten thousand rows holds tens of megabytes several times over in every worker.
ARROW_BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def prepare_workers(spark: SparkSession) -> None:
    """Give the Python workers this package and batches of bounded size."""
    ship_package(spark)
    for key, value in ARROW_BATCH.items():
        spark.conf.set(key, value)


def row_number_in_task() -> Column:
    """Task in the upper bits, row of the task in the lower 33; fixed only once written."""
    return F.monotonically_increasing_id()


TASK_BITS = 33


def task_of(row: Column) -> Column:
    return F.shiftrightunsigned(row, TASK_BITS)


def place_of(row: Column) -> Column:
    return row.bitwiseAND(F.lit((1 << TASK_BITS) - 1))


def _is_scan(df: DataFrame) -> bool:
    """Whether every row is one row of a file read once, as in each job that reads it again.

    So it is for a scan of files, projected or filtered; anything else in the plan may repeat
    rows (an explode, a join, a union) or give other ones next time (a draw, a limit).
    """
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if plan.getClass().getSimpleName() != "LogicalRelation" or not df.inputFiles():
        return False
    # A path named twice, or below another one, is read twice.
    roots = plan.relation().location().rootPaths()
    paths = sorted(f"{roots.apply(i).toString().rstrip('/')}/" for i in range(roots.size()))
    return not any(b.startswith(a) for a, b in zip(paths, paths[1:], strict=False))


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """Add a key that tells rows apart, also repeated ones, and is the same in every job.

    Rows of a plain scan are named by file and place. Any other input is written first, so
    callers that need the key twice hand the keyed frame on.
    """
    from pyspark.errors import AnalysisException

    if "_metadata" not in df.columns and _is_scan(df):
        try:
            key = F.concat_ws(
                ":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")
            )
            keyed = df.withColumn(name, key)
            keyed.schema  # resolves the hidden column
            return keyed
        except AnalysisException:
            pass
    return written(
        df.withColumn(name, row_number_in_task().cast("string")), "keyed"
    )


def free_name(name: str, taken: Sequence[str]) -> str:
    """A column name not among those taken (case does not count in Spark)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name
