"""The eleven learning-platform tables, their schemas and how they are loaded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG, _INT, _TEXT, _DOUBLE = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# All times are Unix epoch seconds held as long; `enddate` 0 means open-ended.
SCHEMAS: dict[str, T.StructType] = {
    "course": _schema(id=_LONG, shortname=_TEXT, startdate=_LONG, enddate=_LONG),
    "context": _schema(id=_LONG, contextlevel=_INT, instanceid=_LONG),
    "role": _schema(id=_LONG, shortname=_TEXT),
    "role_assignments": _schema(id=_LONG, userid=_LONG, contextid=_LONG, roleid=_LONG),
    "logstore_standard_log": _schema(
        id=_LONG, userid=_LONG, courseid=_LONG, eventname=_TEXT, component=_TEXT,
        action=_TEXT, objectid=_LONG, contextinstanceid=_LONG, timecreated=_LONG,
    ),
    "assign": _schema(id=_LONG, course=_LONG),
    "assign_submission": _schema(
        id=_LONG, assignment=_LONG, userid=_LONG, timecreated=_LONG, timemodified=_LONG,
        status=_TEXT, attemptnumber=_LONG, latest=_INT,
    ),
    "assign_grades": _schema(
        id=_LONG, assignment=_LONG, userid=_LONG, attemptnumber=_LONG, grade=_DOUBLE, timemodified=_LONG,
    ),
    "assignfeedback_comments": _schema(id=_LONG, assignment=_LONG, grade=_LONG, commenttext=_TEXT),
    "forum_discussions": _schema(id=_LONG, course=_LONG),
    "forum_posts": _schema(
        id=_LONG, discussion=_LONG, parent=_LONG, userid=_LONG, created=_LONG, message=_TEXT,
    ),
}


DAY = 86400
#: In a log that is stored by day: the day of an event, in days since the epoch, and the partition column of its folders.
LOG_DAY = "log_day"


def store_log_by_day(log: DataFrame, path: str, files_per_day: int = 1, mode: str = "errorifexists") -> None:
    """Write a log as Parquet with one folder per day, up to `files_per_day` files in each, sorted by course and time.

    Whole days are only ever added (`mode="append"`). Read it with `LearningTables.from_parquet(..., log_by_day=True)`: bounds on the time of events
    then choose folders, and the sort lets a scan of some courses skip row groups.
    """
    day = F.expr(f"(timecreated - pmod(timecreated, {DAY})) div {DAY}")
    dealt = log.withColumn(LOG_DAY, day).repartition(F.col(LOG_DAY), F.pmod(F.xxhash64("id"), F.lit(files_per_day)))
    dealt.sortWithinPartitions(LOG_DAY, "courseid", "timecreated").write.mode(mode).partitionBy(LOG_DAY).parquet(path)


def between_times(log: DataFrame, start: int | Column, end: int | Column) -> DataFrame:
    """Log rows with `start <= timecreated <= end`. Of a log stored by day only the folders of those days are read, also where the bounds are
    scalars that are known at run time only."""
    time = F.col("timecreated")
    return log.filter(time_bounds(log, start, end) & (time >= start) & (time <= end))


def time_bounds(log: DataFrame, start: int | Column, end: int | Column) -> Column:
    """A condition on the day that holds wherever the time lies between the bounds; always true where the log has no such column."""
    if LOG_DAY not in log.columns:
        return F.lit(True)
    day = lambda bound: F.floor(F.lit(bound) / DAY) if isinstance(bound, Column) else F.lit(bound // DAY)
    return (F.col(LOG_DAY) >= day(start)) & (F.col(LOG_DAY) <= day(end))


@dataclass(frozen=True)
class LearningTables:
    """One lazy DataFrame per source table."""

    course: DataFrame
    context: DataFrame
    role: DataFrame
    role_assignments: DataFrame
    logstore_standard_log: DataFrame
    assign: DataFrame
    assign_submission: DataFrame
    assign_grades: DataFrame
    assignfeedback_comments: DataFrame
    forum_discussions: DataFrame
    forum_posts: DataFrame

    @classmethod
    def from_reader(cls, read: Callable[[str], DataFrame]) -> LearningTables:
        """Build from any `table name -> DataFrame` reader (catalog, JDBC, ...), checking each schema."""
        return cls(**{field.name: conform(read(field.name), field.name) for field in fields(cls)})

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, log_by_day: bool = False) -> LearningTables:
        """Read `<root>/<table>.parquet` with the declared schemas, so nothing is inferred. `log_by_day`: the log was stored by `store_log_by_day`."""

        def schema(name: str) -> T.StructType:
            by_day = [T.StructField(LOG_DAY, _LONG)] if log_by_day and name == "logstore_standard_log" else []
            return T.StructType(SCHEMAS[name].fields + by_day)

        return cls.from_reader(lambda name: spark.read.schema(schema(name)).parquet(f"{root}/{name}.parquet"))

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, prefix: str = "") -> LearningTables:
        """Read tables registered in the session catalog, for instance a lakehouse copy of the platform."""
        return cls.from_reader(lambda name: spark.table(f"{database}.{prefix}{name}"))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Keep the declared columns in order, and the day of a log stored by day; a missing column or a wrong type is an error."""
    found = {field.name: field.dataType for field in df.schema.fields}
    for field in SCHEMAS[table].fields:
        if field.name not in found:
            raise ValueError(f"table {table} lacks column {field.name}")
        if found[field.name] != field.dataType:
            raise ValueError(
                f"table {table}, column {field.name}: expected {field.dataType.simpleString()}, "
                f"found {found[field.name].simpleString()}"
            )
    by_day = [LOG_DAY] if table == "logstore_standard_log" and found.get(LOG_DAY) == _LONG else []
    return df.select(*SCHEMAS[table].fieldNames(), *by_day)
