"""Reading with enough tasks for heavy per-row work."""

from pyspark.sql import DataFrame


def spread(scan: DataFrame, tasks: int | None) -> DataFrame:
    """Deal the rows of a scan to as many tasks as the caller asks for; None leaves the plan as it is.

    A file with one row group is read by one task, whatever is done per row.
    """
    return scan if tasks is None else scan.repartition(tasks)
