"""Fleet tables derived from the TPC-H-like test tables.

The text of each view runs in Spark SQL and in DuckDB; only the ``{table}`` names are
filled in, with a DataFrame or a view name.  All measures sit on a dyadic grid, so sums are exact in any order and both engines agree bit for bit.
"""

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from fleetwarden.tables import Tables

SCHEDULE_DAY = "2000-01-01"
MAINTENANCE_DAY = "2024-01-30"
READING_INSTANT = "2024-01-30 23:59:59"
CALENDAR_MONTH = "2000-02-01"

# View name -> (source views, text).  Later views may read earlier ones.  All rows of the
# source tables are used.  Failures of every seventh machine are given to the next one,
# so some machines have none and, at some scales, some failures have no machine.
VIEWS = {
    "machines": (
        ["part"],
        """
SELECT 'Machine_' || CAST(p_partkey AS STRING) AS Machine_ID, p_type AS Machine_Type,
  DATE '1995-01-01' + CAST(p_partkey % 1000 AS INT) AS Installation_Date,
  CAST(p_size AS DOUBLE) AS Age,
  CASE p_size % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS Workload,
  CAST(floor(p_retailprice) AS INT) AS Production_Rate, p_size * 200 AS Operational_Hours,
  CASE WHEN p_partkey % 10 = 0 THEN NULL
    ELSE DATE '2024-01-30' - CAST(p_partkey % 120 AS INT) END AS Last_Maintenance_Date,
  CASE p_partkey % 3 WHEN 0 THEN 'Preventive' WHEN 1 THEN 'Corrective' END AS Maintenance_Type,
  CAST(floor(p_retailprice * 4) AS DOUBLE) / 4 AS Maintenance_Cost,
  CAST(p_size AS DOUBLE) / 8 AS Maintenance_Duration,
  CASE WHEN 'Machine_' || CAST(p_partkey AS STRING) LIKE 'Machine_0%' THEN 'Manufacturing'
    WHEN 'Machine_' || CAST(p_partkey AS STRING) LIKE 'Machine_1%' THEN 'Energy'
    WHEN 'Machine_' || CAST(p_partkey AS STRING) LIKE 'Machine_2%' THEN 'Automotive'
    ELSE 'General' END AS Industry
FROM {part}""",
    ),
    "sensor_data": (
        ["events"],
        """
SELECT event_id AS Sensor_ID, 'Machine_' || CAST(user_id AS STRING) AS Machine_ID,
  ts AS Timestamp,
  20 + (CAST(floor(value * 2) AS DOUBLE) / 2) % 80 AS Temperature,
  (CAST(floor(value * 8) AS DOUBLE) / 8) % 10 AS Vibration,
  100 + (CAST(floor(value * 4) AS DOUBLE) / 4) % 50 AS Pressure,
  CAST(40 + user_id % 40 AS DOUBLE) AS Humidity,
  CAST(220 + event_id % 11 AS DOUBLE) AS Voltage, CAST(10 + event_id % 7 AS DOUBLE) AS Current,
  1 + (CAST(floor(value * 4) AS DOUBLE) / 4) % 5 AS Power_Consumption,
  CAST(24 + event_id % 5 AS DOUBLE) AS Ambient_Temperature,
  CAST(60 + event_id % 13 AS DOUBLE) AS Ambient_Humidity,
  CAST(event_id % 129 AS DOUBLE) / 128 AS Anomaly_Score,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS Anomaly_Flag, event_type AS Sensor_Name
FROM {events}""",
    ),
    "failure_records": (
        ["lineitem"],
        """
SELECT l_orderkey * 10 + l_linenumber AS Failure_ID,
  'Machine_' || CAST(CASE WHEN l_partkey % 7 = 0 THEN l_partkey + 1 ELSE l_partkey END AS STRING)
    AS Machine_ID,
  CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS Failure_Status,
  CASE l_linenumber WHEN 1 THEN 'Bearing Failure' WHEN 2 THEN 'Electrical Failure'
    WHEN 3 THEN 'Overheating' WHEN 4 THEN 'Motor Failure' WHEN 5 THEN 'Pressure Leak'
    WHEN 6 THEN 'Humidity Spike' END AS Failure_Type,
  CASE WHEN l_returnflag = 'R' THEN l_quantity / 8 ELSE CAST(0 AS DOUBLE) END AS Downtime,
  CASE WHEN l_linenumber = 7 THEN NULL
    ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) % 257 AS DOUBLE) / 256
    END AS Predicted_Failure_Probability,
  CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS Predicted_Failure_Time
FROM {lineitem}""",
    ),
    "maintenance_schedule": (
        ["orders"],
        """
SELECT o_orderkey AS Maintenance_ID, 'Machine_' || CAST(o_custkey AS STRING) AS Machine_ID,
  CAST(o_orderdate AS DATE) AS Scheduled_Date,
  CASE o_orderstatus WHEN 'F' THEN 'Preventive' WHEN 'O' THEN 'Corrective' ELSE 'Unknown'
    END AS Maintenance_Type,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL
    ELSE CAST(floor(o_totalprice * 4) AS DOUBLE) / 4 END AS Estimated_Cost,
  CAST(substr(o_orderpriority, 1, 1) AS INT) * CAST(0.5 AS DOUBLE) + 1 AS Estimated_Duration
FROM {orders}""",
    ),
    "machine_health_indicators": (
        ["sensor_data"],
        """
SELECT Sensor_ID AS Health_ID, Machine_ID, Timestamp, 1 - Anomaly_Score AS Health_Score,
  Anomaly_Score AS Failure_Probability
FROM {sensor_data}""",
    ),
    "maintenance_effectiveness": (
        ["maintenance_schedule"],
        """
SELECT Scheduled_Date, CAST(100 + Maintenance_ID % 64 AS DOUBLE) AS MTBF_Before,
  CAST(120 + Maintenance_ID % 32 AS DOUBLE) AS MTBF_After
FROM {maintenance_schedule}""",
    ),
}


# The last failure record of a machine (ids can repeat), and the wide telemetry feed: a reading with the
# attributes of its machine and its failure record repeated on every row.  Operating
# hours grow from reading to reading, so the last row of a machine differs from others.
LAST_FAILURE = """
SELECT f.Machine_ID, max(f.Failure_Status) AS Failure_Status, max(f.Failure_Type) AS Failure_Type,
  max(f.Downtime) AS Downtime,
  max(f.Predicted_Failure_Probability) AS Predicted_Failure_Probability,
  max(f.Predicted_Failure_Time) AS Predicted_Failure_Time
FROM {failure_records} f
JOIN (SELECT Machine_ID, max(Failure_ID) AS last_id FROM {failure_records} GROUP BY Machine_ID) l
  ON f.Machine_ID = l.Machine_ID AND f.Failure_ID = l.last_id
GROUP BY f.Machine_ID"""

WIDE_TELEMETRY = """
SELECT s.Machine_ID, m.Machine_Type, m.Installation_Date, m.Age, m.Workload, m.Production_Rate,
  m.Operational_Hours + CAST(s.Sensor_ID % 1000 AS INT) AS Operational_Hours,
  m.Last_Maintenance_Date, m.Maintenance_Type, m.Maintenance_Cost, m.Maintenance_Duration,
  s.Timestamp, s.Temperature, s.Vibration, s.Pressure, s.Humidity, s.Voltage, s.Current,
  s.Power_Consumption, s.Ambient_Temperature, s.Ambient_Humidity, s.Anomaly_Score,
  s.Anomaly_Flag, coalesce(f.Failure_Status, 0) AS Failure_Status, f.Failure_Type, f.Downtime,
  f.Predicted_Failure_Probability, f.Predicted_Failure_Time, s.Sensor_ID
FROM {sensor_data} s JOIN {machines} m ON s.Machine_ID = m.Machine_ID
LEFT JOIN {last_failure} f ON s.Machine_ID = f.Machine_ID"""


# The whole feed: the first failure record of a machine goes with its first reading and so on;
# readings, records and machines that are left over have rows of their own. Sensor_ID numbers
# rows without a reading too, after those that have one.
_RECORD_ORDER = ", ".join(
    f"{c} NULLS FIRST"
    for c in (
        "Failure_ID",
        "Failure_Status",
        "Failure_Type",
        "Downtime",
        "Predicted_Failure_Probability",
        "Predicted_Failure_Time",
    )
)
NUMBERED_READINGS = """
SELECT *, row_number() OVER (PARTITION BY Machine_ID ORDER BY Sensor_ID) AS place FROM {sensor_data}"""
NUMBERED_FAILURES = (
    "SELECT *, row_number() OVER (PARTITION BY Machine_ID ORDER BY "
    + _RECORD_ORDER
    + ") AS place FROM {failure_records}"
)
EVENTS = """
SELECT coalesce(s.Machine_ID, f.Machine_ID) AS Machine_ID, coalesce(s.place, f.place) AS place,
  s.Sensor_ID, s.Timestamp, s.Temperature, s.Vibration, s.Pressure, s.Humidity, s.Voltage, s.Current,
  s.Power_Consumption, s.Ambient_Temperature, s.Ambient_Humidity, s.Anomaly_Score, s.Anomaly_Flag,
  f.Failure_Status, f.Failure_Type, f.Downtime, f.Predicted_Failure_Probability,
  f.Predicted_Failure_Time
FROM {numbered_readings} s
FULL JOIN {numbered_failures} f ON s.Machine_ID = f.Machine_ID AND s.place = f.place"""
KEYED_EVENTS = """
SELECT coalesce(e.Machine_ID, m.Machine_ID) AS Machine_ID, m.Machine_Type, m.Installation_Date,
  m.Age, m.Workload, m.Production_Rate, m.Operational_Hours, m.Last_Maintenance_Date,
  m.Maintenance_Type, m.Maintenance_Cost, m.Maintenance_Duration, e.Timestamp, e.Temperature,
  e.Vibration, e.Pressure, e.Humidity, e.Voltage, e.Current, e.Power_Consumption,
  e.Ambient_Temperature, e.Ambient_Humidity, e.Anomaly_Score, e.Anomaly_Flag,
  coalesce(e.Failure_Status, 0) AS Failure_Status, e.Failure_Type, e.Downtime,
  e.Predicted_Failure_Probability, e.Predicted_Failure_Time,
  coalesce(e.Sensor_ID, 10000000000 + 100000 * CAST(substr(coalesce(e.Machine_ID, m.Machine_ID), 9)
    AS BIGINT) + coalesce(e.place, 0)) AS Sensor_ID
FROM {events_of_machines} e FULL JOIN {machines} m ON e.Machine_ID = m.Machine_ID"""
FEED_COLUMNS = (
    "Machine_ID, Machine_Type, Installation_Date, Age, Workload, Production_Rate, "
    "Operational_Hours + CAST(Sensor_ID % 1000 AS INT) AS Operational_Hours, Last_Maintenance_Date, "
    "Maintenance_Type, Maintenance_Cost, Maintenance_Duration, Timestamp, Temperature, Vibration, "
    "Pressure, Humidity, Voltage, Current, Power_Consumption, Ambient_Temperature, Ambient_Humidity, "
    "Anomaly_Score, Anomaly_Flag, Failure_Status, Failure_Type, Downtime, "
    "Predicted_Failure_Probability, Predicted_Failure_Time, Sensor_ID"
)
# View name -> (source views, text).
FEED_VIEWS = {
    "numbered_readings": (["sensor_data"], NUMBERED_READINGS),
    "numbered_failures": (["failure_records"], NUMBERED_FAILURES),
    "events_of_machines": (["numbered_readings", "numbered_failures"], EVENTS),
    "keyed_events": (["events_of_machines", "machines"], KEYED_EVENTS),
    "feed": (["keyed_events"], f"SELECT {FEED_COLUMNS} FROM {{keyed_events}}"),
}


def sample_views(spark: SparkSession, raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All sample views over the given raw tables."""
    frames = dict(raw)
    for name, (reads, text) in VIEWS.items():
        frames[name] = spark.sql(text, **{r: frames[r] for r in reads})
    return frames


@lru_cache(maxsize=8)
def sample_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The sample views over one scale folder; plans only, no data is kept."""
    raw_tables = ("part", "events", "lineitem", "orders")
    raw = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in raw_tables}
    frames = sample_views(spark, raw)
    return Tables(**{name: frames[name] for name in VIEWS})


def whole_feed(spark: SparkSession, t: Tables) -> DataFrame:
    """Every reading, failure record and machine as rows of the wide feed."""
    frames = {n: getattr(t, n) for n in ("sensor_data", "failure_records", "machines")}
    for name, (reads, text) in FEED_VIEWS.items():
        frames[name] = spark.sql(text, **{r: frames[r] for r in reads})
    return frames["feed"]


def last_failures(spark: SparkSession, t: Tables) -> DataFrame:
    """The last failure record of each machine."""
    return spark.sql(LAST_FAILURE, failure_records=t.failure_records)


def wide_telemetry(spark: SparkSession, t: Tables, last: DataFrame | None = None) -> DataFrame:
    """A reading of a known machine a row, with the machine's last failure record; a stream of
    readings will do. ``Sensor_ID`` gives the order of rows; ``last`` is ``last_failures``, where
    it is stored."""
    last = last_failures(spark, t) if last is None else last
    return spark.sql(
        WIDE_TELEMETRY, sensor_data=t.sensor_data, machines=t.machines, last_failure=last
    )


def oracle_prefix() -> str:
    """WITH clause that defines every sample view in DuckDB."""
    texts = {name: (reads, text) for name, (reads, text) in VIEWS.items()}
    texts["last_failure"] = (["failure_records"], LAST_FAILURE)
    texts["telemetry"] = (["sensor_data", "machines", "last_failure"], WIDE_TELEMETRY)
    texts |= FEED_VIEWS
    parts = [
        f"{name} AS ({text.strip().format(**{r: r for r in reads})})"
        for name, (reads, text) in texts.items()
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"
