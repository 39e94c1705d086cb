"""Fixed schemas of the fleet tables and of the wide telemetry feed."""

from pyspark.sql import types as T


def _schema(**columns):
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_text, _real, _whole, _long = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
_date, _instant = T.DateType(), T.TimestampNTZType()

MACHINES = _schema(
    Machine_ID=_text,
    Machine_Type=_text,
    Installation_Date=_date,
    Age=_real,
    Workload=_text,
    Production_Rate=_whole,
    Operational_Hours=_whole,
    Last_Maintenance_Date=_date,
    Maintenance_Type=_text,
    Maintenance_Cost=_real,
    Maintenance_Duration=_real,
    Industry=_text,
)

SCHEDULE_OVERRIDES = _schema(Machine_ID=_text, Scheduled_Date=_date)

# As stored: with the number of the load that a row came from.
LOAD_ORDER = "Load_Order"
STORED_MACHINES = T.StructType([*MACHINES.fields, T.StructField(LOAD_ORDER, _long)])
STORED_OVERRIDES = T.StructType([*SCHEDULE_OVERRIDES.fields, T.StructField(LOAD_ORDER, _long)])

SENSOR_DATA = _schema(
    Sensor_ID=_long,
    Machine_ID=_text,
    Timestamp=_instant,
    Temperature=_real,
    Vibration=_real,
    Pressure=_real,
    Humidity=_real,
    Voltage=_real,
    Current=_real,
    Power_Consumption=_real,
    Ambient_Temperature=_real,
    Ambient_Humidity=_real,
    Anomaly_Score=_real,
    Anomaly_Flag=_whole,
    Sensor_Name=_text,
)

# Hourly sums of the sensors that reports average by hour or day.
ROLLED = ("Temperature", "Vibration", "Pressure", "Humidity", "Power_Consumption", "Anomaly_Score")
SENSOR_HOURLY = _schema(
    Machine_ID=_text,
    _day=_date,
    _hour=_whole,
    **{f"sum_{s}": _real for s in ROLLED},
    **{f"count_{s}": _long for s in ROLLED},
)

FAILURE_RECORDS = _schema(
    Failure_ID=_long,
    Machine_ID=_text,
    Failure_Status=_whole,
    Failure_Type=_text,
    Downtime=_real,
    Predicted_Failure_Probability=_real,
    Predicted_Failure_Time=_instant,
)

MAINTENANCE_SCHEDULE = _schema(
    Maintenance_ID=_long,
    Machine_ID=_text,
    Scheduled_Date=_date,
    Maintenance_Type=_text,
    Estimated_Cost=_real,
    Estimated_Duration=_real,
)

ANOMALY_DETECTION = _schema(
    Anomaly_ID=_long,
    Machine_ID=_text,
    Timestamp=_instant,
    Anomaly_Score=_real,
    Anomaly_Flag=_whole,
)

MACHINE_HEALTH_INDICATORS = _schema(
    Health_ID=_long,
    Machine_ID=_text,
    Timestamp=_instant,
    Health_Score=_real,
    Failure_Probability=_real,
)

FAILURE_TRENDS = _schema(Machine_Type=_text, Timestamp=_date, Failure_Rate=_real)

MAINTENANCE_EFFECTIVENESS = _schema(Scheduled_Date=_date, MTBF_Before=_real, MTBF_After=_real)

# Header of the wide telemetry file -> column name used in the tables (fixed values).
TELEMETRY_HEADERS = {
    "Machine_ID": "Machine_ID",
    "Machine_Type": "Machine_Type",
    "Installation_Date": "Installation_Date",
    "Age": "Age",
    "Workload": "Workload",
    "Production_Rate": "Production_Rate",
    "Operational_Hours": "Operational_Hours",
    "Last_Maintenance_Date": "Last_Maintenance_Date",
    "Maintenance_Type": "Maintenance_Type",
    "Maintenance_Cost ($)": "Maintenance_Cost",
    "Maintenance_Duration (hrs)": "Maintenance_Duration",
    "Timestamp": "Timestamp",
    "Temperature (°C)": "Temperature",
    "Vibration (mm/s)": "Vibration",
    "Pressure (psi)": "Pressure",
    "Humidity (%)": "Humidity",
    "Voltage (V)": "Voltage",
    "Current (A)": "Current",
    "Power_Consumption (kW)": "Power_Consumption",
    "Ambient_Temperature (°C)": "Ambient_Temperature",
    "Ambient_Humidity (%)": "Ambient_Humidity",
    "Anomaly_Score": "Anomaly_Score",
    "Anomaly_Flag": "Anomaly_Flag",
    "Failure_Status": "Failure_Status",
    "Failure_Type": "Failure_Type",
    "Downtime (hrs)": "Downtime",
    "Predicted_Failure_Probability": "Predicted_Failure_Probability",
    "Predicted_Failure_Time": "Predicted_Failure_Time",
}

_by_name = {
    field.name: field.dataType
    for table in (MACHINES, SENSOR_DATA, FAILURE_RECORDS)
    for field in table
}

TELEMETRY = T.StructType(
    [T.StructField(name, _by_name[name], True) for name in TELEMETRY_HEADERS.values()]
)
