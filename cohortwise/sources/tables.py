"""Reading study tables and writing results.

Every input has a declared schema; nothing is inferred. CSV is what studies
deliver, parquet (events partitioned by ``data_name``) is what to keep at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.functions.calendar import text_to_date, text_to_ts


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}


def _schema(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields.items()])


def _items(count: int, prefix: str = "s_", first: int = 1) -> dict[str, str]:
    return {f"{prefix}{i}": "int" for i in range(first, first + count)}


_EVENTS = _schema(p_id="string", timestamp="string", dataName="string")
_NOTIFICATION = dict(p_id="string", notification_time="double", start_time="double", end_time="double")

SCHEMAS: dict[str, T.StructType] = {
    "participants": _schema(subject_id="string", enrolment_date="string", withdrawal_date="string"),
    "active": _EVENTS,
    "passive": _EVENTS,
    "assessment": _schema(p_id="string", timestamp="string"),
    "demographics": _schema(
        p_id="string", dob="string", age="double", sex="string", site="string", marry_align="string", children="string",
        edu_age_align="double", edu_degree_align="string", income_align="string", income_num="int",
        accommodation_occupy_align="string", accommodation_satisfy="string",
    ),
    "contacts": _schema(p_id="string", date="string", record_num="int", comms="string", site="string"),
    "ids": _schema(p_id="string", date="string", record_num="int", ids_score="double"),
    "usability": _schema(p_id="string"),
    "audio": _schema(**_NOTIFICATION),
    "esm": _schema(**_NOTIFICATION),
    "esm28": _schema(**_NOTIFICATION),
    "phq8": _schema(**_NOTIFICATION, **_items(8)),
    "rses": _schema(**_NOTIFICATION, **_items(10)),
    "phone_brand": _schema(p_id="string", phone_brand="int"),
    "employment": _schema(subject_id="string", redcap_event_name="string", EMPLOYMENT_STATUS="string"),
    "comorbidity": _schema(p_id="string", **_items(19, "ill_", 0)),
    "medication": _schema(p_id="string", depression_medication="int"),
    "ethnicity": _schema(subject_id="string", ETHCAT2="string"),
    "phone_status": _schema(p_id="string", phone_status="int"),
}


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One study table with header; ``NA`` and empty fields are null.

    Columns are found by their names in the header, wherever they stand; further
    columns are left out and a missing one is an error.
    """
    raw = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    fields = SCHEMAS[table].fields
    missing = [f.name for f in fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    number = {"int", "double"}
    return raw.select(*[F.trim(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.dataType.simpleString() in number else F.col(f"`{f.name}`") for f in fields])


def read_parquet(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The same table from parquet, restricted to the declared columns that are present."""
    df = spark.read.parquet(path)
    return df.select(*[F.col(field.name).cast(field.dataType) for field in SCHEMAS[table] if field.name in df.columns])


def events_from_raw(raw: DataFrame) -> DataFrame:
    """``(p_id, ts, data_name)`` with UTC instants."""
    data_name = F.col("dataName") if "dataName" in raw.columns else F.lit(None).cast("string")
    return raw.select("p_id", text_to_ts("timestamp").alias("ts"), data_name.alias("data_name"))


def dated_records(raw: DataFrame, pattern: str) -> DataFrame:
    """Parse the ``date`` text of a visit log; administrative columns are dropped."""
    return raw.drop("comms", "site").withColumn("date", F.to_date(text_to_ts("date", pattern)))


def enrollment_from_raw(raw: DataFrame) -> DataFrame:
    """Participant dimension ``(p_id, enrollment_date, withdrawal_date)``."""
    return raw.select(
        F.col("subject_id").alias("p_id"),
        text_to_date("enrolment_date").alias("enrollment_date"),
        text_to_date("withdrawal_date").alias("withdrawal_date"),
    )


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """First column of a header-less tab-separated file as ``p_id``."""
    return spark.read.schema("p_id string").option("sep", "\t").option("header", False).csv(path)


def write_id_list(ids: DataFrame, path: str) -> None:
    """One id per line, no header and no quotes."""
    ids.select(F.col("p_id").cast("string")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Result table as CSV with header; nulls are written as ``NA``."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def write_events(events: DataFrame, path: str) -> None:
    """Event table as parquet in one folder per data type, so type filters prune whole folders."""
    events.write.mode("overwrite").partitionBy("data_name").parquet(path)
