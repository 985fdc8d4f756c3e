"""Declared table layouts (an absent field is NULL)."""

from pyspark.sql import types as T

from palisade.functions.network import SERVICE_PORTS

_TEXT, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
_DOUBLE, _TIME, _BOOL = T.DoubleType(), T.TimestampType(), T.BooleanType()
_TEXTS = T.ArrayType(T.StringType())


def _layout(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# What is computed of every event when it is stored; fields of the other type are NULL.
FEATURE_SCHEMA = _layout(
    **dict.fromkeys(
        "bytes_sent bytes_received packets_sent packets_received total_bytes total_packets".split(), _LONG
    ),
    avg_packet_size=_DOUBLE,
    **dict.fromkeys("protocol_tcp protocol_udp protocol_icmp protocol_other src_port dst_port".split(), _INT),
    **dict.fromkeys(
        "well_known_port_src well_known_port_dst ephemeral_port_src ephemeral_port_dst".split(), _INT
    ),
    **{f"service_{s}": _INT for s in SERVICE_PORTS},
    is_private_src=_INT,
    is_private_dst=_INT,
    **dict.fromkeys("flow_duration packets_per_second bytes_per_second".split(), _DOUBLE),
    **{f"tcp_{f}": _INT for f in ("syn", "ack", "fin", "rst", "psh")},
    **dict.fromkeys("has_process is_system_process is_shell cmd_length cmd_has_pipe".split(), _INT),
    **dict.fromkeys("cmd_has_redirect cmd_has_background cmd_suspicious has_username is_root".split(), _INT),
    unusual_parent_child=_INT,
    process_spawn_rate=_DOUBLE,
    login_frequency=_LONG,
    command_execution_rate=_DOUBLE,
)

EVENT_SCHEMA = _layout(
    event_id=_LONG,
    timestamp=_TIME,
    event_type=_TEXT,
    source=_TEXT,
    src_ip=_TEXT,
    dst_ip=_TEXT,
    src_port=_INT,
    dst_port=_INT,
    protocol=_TEXT,
    bytes_sent=_LONG,
    bytes_received=_LONG,
    packets_sent=_LONG,
    packets_received=_LONG,
    hostname=_TEXT,
    username=_TEXT,
    process_name=_TEXT,
    process_id=_INT,
    command_line=_TEXT,
    parent_process=_TEXT,
    raw_data=_TEXT,
    features=FEATURE_SCHEMA,
    created_at=_TIME,
)

ALERT_SCHEMA = _layout(
    alert_id=_TEXT,
    event_id=_LONG,
    title=_TEXT,
    description=_TEXT,
    severity=_TEXT,
    status=_TEXT,
    detection_type=_TEXT,
    confidence_score=_DOUBLE,
    signature_id=_LONG,
    matched_rules=_TEXT,
    anomaly_score=_DOUBLE,
    model_name=_TEXT,
    fusion_score=_DOUBLE,
    contributing_factors=T.MapType(T.StringType(), T.DoubleType()),
    geoip_data=_TEXT,
    threat_intel=_TEXT,
    asset_criticality=_TEXT,
    attack_tactics=_TEXTS,
    attack_techniques=_TEXTS,
    assigned_to=_TEXT,
    investigated_at=_TIME,
    resolved_at=_TIME,
    resolution_notes=_TEXT,
    false_positive=_BOOL,
    created_at=_TIME,
    updated_at=_TIME,
    event_time=_TIME,
)

CONDITION_SCHEMA = _layout(
    field=_TEXT,
    op=_TEXT,
    value=_TEXT,
    values=_TEXTS,
    min=_DOUBLE,
    max=_DOUBLE,
    pattern=_TEXT,
)

SIGNATURE_SCHEMA = _layout(
    signature_id=_LONG,
    name=_TEXT,
    description=_TEXT,
    rule_type=_TEXT,
    rule_content=_TEXT,
    event_type=_TEXT,
    conditions=T.ArrayType(CONDITION_SCHEMA),
    threshold=_INT,
    time_window_seconds=_INT,
    grouping_key=_TEXT,
    ioc_values=_TEXTS,
    severity=_TEXT,
    enabled=_BOOL,
    confidence=_DOUBLE,
    category=_TEXT,
    tags=_TEXTS,
    references=_TEXTS,
    attack_tactics=_TEXTS,
    attack_techniques=_TEXTS,
    steps=T.ArrayType(T.ArrayType(CONDITION_SCHEMA)),
    reset=T.ArrayType(CONDITION_SCHEMA),
)

IOC_SCHEMA = _layout(
    ioc_type=_TEXT,
    value=_TEXT,
    threat_type=_TEXT,
    confidence=_DOUBLE,
    severity=_TEXT,
    source=_TEXT,
    description=_TEXT,
    tags=_TEXTS,
    is_active=_BOOL,
    first_seen=_TIME,
    last_seen=_TIME,
)

MODEL_SCHEMA = _layout(
    seq=_LONG,
    name=_TEXT,
    version=_TEXT,
    model_type=_TEXT,
    file_path=_TEXT,
    parameters=T.MapType(T.StringType(), T.StringType()),
    training_dataset=_TEXT,
    training_date=_TIME,
    training_samples=_LONG,
    validation_accuracy=_DOUBLE,
    precision=_DOUBLE,
    recall=_DOUBLE,
    f1_score=_DOUBLE,
    false_positive_rate=_DOUBLE,
    deployed_at=_TIME,
)

COMMENT_SCHEMA = _layout(alert_id=_TEXT, author=_TEXT, comment=_TEXT, created_at=_TIME)

INCIDENT_SCHEMA = _layout(
    incident_id=_TEXT,
    n_alerts=_LONG,
    severity=_TEXT,
    status=_TEXT,
    first_alert_at=_TIME,
    last_alert_at=_TIME,
)
