"""Row shapes of the tables the library reads and writes."""

from pyspark.sql import types as T

STRING_MAP = T.MapType(T.StringType(), T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# A nested condition or action is kept as JSON text: its shape is recursive.
ACTION = _struct(
    class_name=T.StringType(),
    message=T.StringType(),
    level=T.StringType(),
    reason=T.StringType(),
    job_config=T.StringType(),
)

LOG_EVENT = _struct(
    name=T.StringType(),
    pattern=T.StringType(),
    pattern_type=T.StringType(),
    match_once=T.BooleanType(),
    extract_groups=STRING_MAP,
    metadata=STRING_MAP,
    action=ACTION,
    condition=T.StringType(),
)

STATE_EVENT = _struct(
    name=T.StringType(),
    transition=T.ArrayType(T.StringType()),
    metadata=STRING_MAP,
    action=ACTION,
    condition=T.StringType(),
)

DEFINITION = _struct(
    class_name=T.StringType(),
    name=T.StringType(),
    command=T.ArrayType(T.StringType()),
    extra_args=T.ArrayType(T.StringType()),
    array_args=T.ArrayType(T.ArrayType(T.StringType())),
    array_len=T.IntegerType(),
    log_to_file=T.BooleanType(),
    log_path=T.StringType(),
    log_path_current=T.StringType(),
    metadata=STRING_MAP,
    slurm=T.StringType(),
    log_events=T.ArrayType(LOG_EVENT),
    state_events=T.ArrayType(STATE_EVENT),
    start_condition=T.StringType(),
    cancel_condition=T.StringType(),
    finish_condition=T.StringType(),
)

RUNTIME = _struct(
    submitted=T.BooleanType(),
    attempts=T.IntegerType(),
    runtime_job_id=T.StringType(),
    start_ts=T.DoubleType(),
    end_ts=T.DoubleType(),
    log_cursor=T.LongType(),
    condition_state=T.StringType(),
    action_state=T.StringType(),
    last_status=T.StringType(),
    final_state=T.StringType(),
)

# Older records name the definition ``registration``.
JOB_RECORD = T.StructType(
    [
        T.StructField("class_name", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("definition", DEFINITION),
        T.StructField("registration", DEFINITION),
        T.StructField("runtime", RUNTIME),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("array_idx", T.IntegerType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

LOG_CHUNKS = _struct(
    job_id=T.StringType(), chunk_seq=T.LongType(), ts=T.TimestampNTZType(), text=T.StringType()
)

STATUS_SNAPSHOTS = _struct(
    runtime_job_id=T.StringType(), ts=T.TimestampNTZType(), source=T.StringType(), status=T.StringType()
)

MARKERS = _struct(path=T.StringType(), content=T.StringType(), ts=T.TimestampNTZType())
