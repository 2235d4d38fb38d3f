"""Running positions of all rows without a window over all rows.

Two levels of sums: each task numbers the rows that it writes, and an offset for each task, the sum of the counts before
it, makes these numbers one running position. The driver sees one count for each task; no task sees more than its part.
With an order the parts are ranges of it, so the positions follow the order across parts.

Edge cases: nulls are ordered as the order says (nulls first by default); rows that the order leaves equal are numbered
as they come and spread over parts like others, however many they are; an empty table gives an empty result; a column
that already has the new name is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import stored

Writer = Callable[[DataFrame, str], DataFrame]
#: monotonically_increasing_id has the task above this bit and the row in its task below.
TASK_BIT = 33


def _free(taken: Iterable[str], name: str) -> str:
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def with_ordinal(df: DataFrame, order: Iterable[str | Column] = (), *, name: str = "ordinal", start: int = 0, unique: bool = False, write: Writer = stored) -> DataFrame:
    """``df`` with each row's running position in ``order``, or as the rows are read where there is none.

    ``unique`` says that no two rows are equal in the order, and saves the write that tells such rows apart. ``write``
    puts a table into the shared folder and reads it again.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"{name} is already a column")
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    at = _free([*df.columns, name], "row_place")
    if order and not unique:
        tie = _free([*df.columns, name, at], "row_tie")
        df = write(df.withColumn(tie, F.monotonically_increasing_id()), "ordinal-ties")
        return with_ordinal(df, [*order, F.col(tie)], name=name, start=start, unique=True, write=write).drop(tie)
    if order:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = write(df.withColumn(at, F.monotonically_increasing_id()), "ordinal-rows")
    task = F.shiftright(at, TASK_BIT).cast("int")
    before, offsets = start, []
    for r in placed.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect():
        offsets.append((r["task"], before))
        before += r["n"]
    task_name, base = _free([*placed.columns, name], "row_task"), _free([*placed.columns, name], "row_base")
    table = df.sparkSession.createDataFrame(offsets, f"`{task_name}` int, `{base}` long")
    row = F.col(at).bitwiseAND(F.lit((1 << TASK_BIT) - 1))
    placed = placed.withColumn(task_name, task).join(F.broadcast(table), task_name)  # a row for each task that wrote
    return placed.withColumn(name, F.col(base) + row).drop(task_name, base, at)


def with_position(df: DataFrame, by: Iterable[str], order: Iterable[str | Column], *, name: str = "position", start: int = 0, unique: bool = False, write: Writer = stored) -> DataFrame:
    """``df`` with each row's position among those that share ``by`` (nulls are equal), however many these are."""
    by = list(by)
    at = _free([*df.columns, name], "group_place")
    placed = with_ordinal(df, [*by, *order], name=at, unique=unique, write=write)
    first = _free([*placed.columns, name], "group_first")
    keys = {c: _free([*placed.columns, name, first], f"group_{c}") for c in by}
    starts = placed.groupBy(*(F.col(c).alias(k) for c, k in keys.items())).agg(F.min(at).alias(first))
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    return placed.join(starts, same).withColumn(name, F.col(at) - F.col(first) + start).drop(at, first, *keys.values())


def with_next(df: DataFrame, by: Iterable[str], order: Iterable[str | Column], columns: Iterable[str], *, prefix: str = "next_", unique: bool = False, block: int = 1 << 16, write: Writer = stored) -> DataFrame:
    """``df`` with ``columns`` of the next row among those that share ``by`` (nulls are equal), null for the last of them.

    Rows meet in blocks of their running positions, not by ``by``, so no group makes a task longer; a block's first row
    also stands behind the block before it.
    """
    by, columns = list(by), list(columns)
    at = _free([*df.columns, *(prefix + c for c in columns)], "group_place")
    part = _free([*df.columns, *(prefix + c for c in columns), at], "row_block")
    placed = with_ordinal(df, [*by, *order], name=at, unique=unique, write=write)
    own = F.floor(F.col(at) / block).cast("long")
    rows = placed.withColumn(part, F.explode(F.when((F.col(at) % block == 0) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))))
    window = Window.partitionBy(part).orderBy(at)
    same = F.lead(F.lit(True)).over(window).isNotNull()
    for c in by:
        same = same & F.lead(c).over(window).eqNullSafe(F.col(c))
    following = [F.when(same, F.lead(c).over(window)).alias(prefix + c) for c in columns]
    return rows.select("*", *following).where(F.col(part) == own).drop(at, part)
