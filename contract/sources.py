"""Source and sink queries: text, files and captures made from the given tables."""

from pyspark.sql import functions as F

from contract.adapters import (
    ALL_RULES,
    HOST,
    HOST_SQL,
    K,
    NET,
    NET_SQL,
    US,
    all_events,
    created_at,
    raw_events,
)
from contract.detection import NAMES, PATTERN_SQL, _names_sql
from contract.packets import CUT_FILE, EVENTS_PER_FILE, FACES, HEADERS, LINKS, capture_files, write_capture_folder
from contract.registry import query, table
from palisade.anomaly.prep import sample_rows
from palisade.functions.indicators import indicator_type
from palisade.operators.changelog import current_iocs, feed_counts
from palisade.plans.detect import detect
from palisade.session import scratch_path, written
from palisade.sources import datasets, feeds, logs, sinks
from palisade.sources.captures import packet_events, packets, read_packets
from palisade.sources.flows import flow_events

NOW_US = 1706745600000000  # 2024-02-01
YEAR = 2024


def host_rows(spark, sf):
    """Host adapter columns with k, before they become text."""
    return raw_events(spark, sf).selectExpr(
        *[f"{e} AS {a}" for a, e in HOST.items()], "k", "user_id"
    )


HOSTK_SQL = (
    "hostk AS (SELECT " + ", ".join(f"{e} AS {a}" for a, e in HOST.items()) + f", k, user_id FROM"
    f" (SELECT event_id, ts, user_id, event_type AS raw_type, value, {K} AS k FROM events))"
)


def micros_or_null(name="timestamp"):
    return F.unix_micros(name).alias("ts_us")


@query(
    "netflow_normalize",
    """SELECT l_orderkey, l_linenumber, l_partkey, epoch_us(l_shipdate) AS ts_us, '10.1.' || l_suppkey || '.1' AS src_ip,
      CAST(l_partkey % 65536 AS INT) AS dst_port,
      CASE CAST(l_quantity AS INT) WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 41 THEN 'IPv6'
        WHEN 47 THEN 'GRE' WHEN 50 THEN 'ESP' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS protocol,
      CASE WHEN l_linenumber = 3 THEN 0 ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS bytes_sent,
      CAST(l_linenumber AS BIGINT) AS packets_sent, CAST(NULL AS BIGINT) AS bytes_received
    FROM lineitem""",
)
def netflow_normalize(spark, sf):
    """Line items as flow records."""
    records = table(spark, sf, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("id"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
        F.concat(F.lit("10.1."), F.col("l_suppkey").cast("string"), F.lit(".1")).alias("srcaddr"),
        F.lit("10.2.0.1").alias("dstaddr"),
        F.lit(40000).alias("srcport"),
        (F.col("l_partkey") % 65536).alias("dstport"),
        F.col("l_quantity").cast("int").alias("protocol"),
        F.when(F.col("l_linenumber") != 3, F.floor("l_extendedprice")).alias("bytes"),
        F.col("l_linenumber").alias("packets"),
    )
    events = flow_events(records.withColumn("event_id", F.lit(0)))
    raw = F.from_json("raw_data", "id STRUCT<l_orderkey: BIGINT, l_linenumber: INT, l_partkey: BIGINT>")
    return events.select(
        raw["id"]["l_orderkey"].alias("l_orderkey"),
        raw["id"]["l_linenumber"].alias("l_linenumber"),
        raw["id"]["l_partkey"].alias("l_partkey"),
        micros_or_null(), "src_ip", "dst_port", "protocol", "bytes_sent", "packets_sent",
        "bytes_received",
    )


def _syslog_time():
    stamp = F.col("ts").cast("timestamp")
    day = F.lpad(F.date_format(stamp, "d"), 2, " ")
    return F.concat_ws(" ", F.date_format(stamp, "MMM"), day, F.date_format(stamp, "HH:mm:ss"))


def _process():
    return F.coalesce(F.expr("nullif(process_name, '')"), F.lit("proc"))


def syslog_lines(rows):
    pid = F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit("["), F.col("process_id").cast("string"), F.lit("]"))
    )
    whole = F.concat(
        F.lit("<"), F.col("k").cast("string"), F.lit(">"), _syslog_time(), F.lit(" "),
        F.col("hostname"), F.lit(" "), _process(), pid, F.lit(": "), F.col("message"),
    )
    line = F.when(F.col("k") % 10 == 9, F.lit("<34>no message")).otherwise(whole)
    return rows.select("event_id", F.lit("a.log").alias("source"), line.alias("line"))


@query(
    "syslog_parse",
    f"""WITH {HOSTK_SQL} SELECT event_id, epoch_us(ts) - epoch_us(ts) % {US} AS ts_us, hostname,
      coalesce(nullif(process_name, ''), 'proc') AS process_name,
      CASE WHEN k % 3 <> 0 THEN process_id END AS process_id, message, k AS priority
    FROM hostk WHERE k % 10 <> 9""",
)
def syslog_parse(spark, sf):
    """Events written as syslog lines and read back; malformed lines drop out."""
    out = logs.parse_text_lines(written(syslog_lines(host_rows(spark, sf)), "syslog"), F.lit(YEAR), created_at())
    return out.select(
        "event_id", micros_or_null(), "hostname", "process_name", "process_id",
        F.get_json_object("raw_data", "$.message").alias("message"),
        F.get_json_object("raw_data", "$.priority").cast("int").alias("priority"),
    )


def audit_lines(rows):
    stamp = F.unix_millis(F.col("ts").cast("timestamp"))
    seconds = F.concat(
        F.floor(stamp / 1000).cast("string"), F.lit("."), F.lpad((stamp % 1000).cast("string"), 3, "0")
    )
    pid = F.when(F.col("k") % 13 == 0, F.lit("abc")).otherwise(F.col("process_id").cast("string"))
    command = F.when(
        F.col("command_line").isNotNull(),
        F.concat(F.lit(' a0="'), F.col("command_line"), F.lit('"')),
    ).otherwise("")
    line = F.concat(
        F.lit("type=SYSCALL msg=audit("), seconds, F.lit(":"), F.col("k").cast("string"),
        F.lit("): syscall=59 pid=1 pid="), pid, F.lit(" uid="), (F.col("user_id") % 10).cast("string"),
        F.lit(' comm="'), _process(), F.lit('"'), command, F.lit(" success=yes exit="),
        F.col("k").cast("string"),
    )
    return rows.select("event_id", F.lit("audit.log").alias("source"), line.alias("line"))


@query(
    "audit_parse",
    f"""WITH {HOSTK_SQL} SELECT event_id, epoch_us(ts) - epoch_us(ts) % 1000 AS ts_us,
      CAST(user_id % 10 AS VARCHAR) AS username, coalesce(nullif(process_name, ''), 'proc') AS process_name,
      CASE WHEN k % 13 <> 0 THEN process_id END AS process_id,
      command_line,
      'SYSCALL' AS audit_type, CAST(k AS VARCHAR) AS exit_code FROM hostk""",
)
def audit_parse(spark, sf):
    """Events written as audit records and read back; the last duplicate key wins."""
    out = logs.parse_text_lines(written(audit_lines(host_rows(spark, sf)), "audit"), F.lit(YEAR), created_at())
    return out.select(
        "event_id", micros_or_null(), "username", "process_name", "process_id", "command_line",
        F.get_json_object("raw_data", "$.audit_type").alias("audit_type"),
        F.get_json_object("raw_data", "$.all_fields.exit").alias("exit_code"),
    )


def json_lines(rows):
    stamp = F.col("ts").cast("timestamp")
    iso = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    epoch = F.unix_seconds(stamp)
    shapes = [
        [
            ("timestamp", iso), ("hostname", F.col("hostname")), ("user", F.col("username")),
            ("process", F.col("process_name")), ("pid", F.col("process_id")),
            ("command", F.col("command_line")), ("message", F.col("message")),
        ],
        [
            ("timestamp", F.lit("")), ("@timestamp", iso), ("host", F.col("hostname")),
            ("username", F.col("username")), ("ProcessName", F.col("process_name")),
            ("ProcessId", F.col("process_id").cast("string")), ("CommandLine", F.col("command_line")),
            ("message", F.col("message")),
        ],
        [
            ("time", epoch), ("computer", F.col("hostname")), ("user", F.lit("")),
            ("username", F.col("username")), ("process", F.col("process_name")),
            ("pid", F.col("process_id")), ("command", F.col("command_line")),
            ("message", F.col("message")),
        ],
    ]
    texts = [F.to_json(F.struct(*[c.alias(n) for n, c in shape])) for shape in shapes]
    line = (
        F.when(F.col("k") % 17 == 0, F.lit('{"broken": '))
        .when(F.col("k") % 19 == 0, F.lit("  "))
        .when(F.col("k") % 3 == 0, texts[0])
        .when(F.col("k") % 3 == 1, texts[1])
        .otherwise(texts[2])
    )
    return rows.select("event_id", F.lit("a.json").alias("source"), line.alias("line"))


JSON_WHERE = "k % 17 <> 0 AND k % 19 <> 0"


@query(
    "json_log_parse",
    f"""WITH {HOSTK_SQL} SELECT event_id,
      CASE WHEN k % 3 = 2 THEN epoch_us(ts) - epoch_us(ts) % {US} ELSE epoch_us(ts) END AS ts_us,
      hostname, username, nullif(process_name, '') AS process_name, process_id,
      nullif(command_line, '') AS command_line, message FROM hostk WHERE {JSON_WHERE}""",
)
def json_log_parse(spark, sf):
    """Events written as JSON lines with alternating field names and read back."""
    out = logs.parse_json_lines(written(json_lines(host_rows(spark, sf)), "json"), F.lit(YEAR), created_at())
    return out.select(
        "event_id", micros_or_null(), "hostname", "username", "process_name", "process_id",
        "command_line", F.get_json_object("raw_data", "$.message").alias("message"),
    )


@query(
    "log_text_route",
    """WITH l AS (SELECT conv_id, turn, trim(unnest(string_split(text, chr(10))), ' ') AS t FROM conversations),
    m AS (SELECT CASE turn % 3 WHEN 0 THEN '<' || turn || '>' || t WHEN 1 THEN 'type=SYSCALL ' || t ELSE t END AS line FROM l)
    SELECT CASE WHEN contains(line, 'type=SYSCALL') OR contains(line, 'type=EXECVE') THEN 'audit'
      WHEN regexp_matches(line, '^<[0-9]+>') THEN 'syslog' ELSE 'generic' END AS fmt, count(*) AS n
    FROM m GROUP BY 1""",
)
def log_text_route(spark, sf):
    """Format of every conversation line, some of them marked as other formats."""
    lines = (
        table(spark, sf, "conversations")
        .select("turn", F.explode(F.split("text", "\n")).alias("t"))
        .withColumn("t", F.trim("t"))
    )
    marked = lines.select(
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<"), F.col("turn").cast("string"), F.lit(">"), F.col("t")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("type=SYSCALL "), F.col("t")))
        .otherwise(F.col("t"))
        .alias("line")
    )
    return (
        marked.select(logs.log_format(F.col("line")).alias("fmt"))
        .groupBy("fmt")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "generic_log_lines",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents),
    m AS (SELECT doc_id, trim(t, ' ') AS line FROM l)
    SELECT doc_id AS event_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars,
      CAST({NOW_US} AS BIGINT) AS ts_us
    FROM m WHERE line <> '' AND NOT starts_with(line, '#')
      AND NOT contains(line, 'type=SYSCALL') AND NOT contains(line, 'type=EXECVE')
      AND NOT regexp_matches(line, '^<[0-9]+>') GROUP BY doc_id""",
)
def generic_log_lines(spark, sf):
    """Every line of every document as a plain log line; the time is the reading time."""
    lines = table(spark, sf, "documents").select(
        F.col("doc_id").alias("event_id"), F.col("source"), F.explode(F.split("text", "\n")).alias("line")
    )
    plain = lines.where(logs.log_format(F.trim("line")) == "generic")
    out = logs.parse_text_lines(plain, F.lit(YEAR), created_at())
    message = F.get_json_object("raw_data", "$.message")
    return out.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.length(message)).cast("long").alias("n_chars"),
        F.max(F.unix_micros("timestamp")).alias("ts_us"),
    )


def xml_rows(rows):
    """Rows in the layout the XML writer turns into event elements."""

    def data(name, value):
        return F.struct(F.lit(name).alias("_Name"), value.alias("_VALUE"))

    pid = F.when(
        F.col("k") % 2 == 0, F.concat(F.lit("0x"), F.lower(F.hex(F.col("process_id").cast("long"))))
    ).otherwise(F.col("process_id").cast("string"))
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    # Seven fraction digits, as exports have.
    system = F.struct(
        F.col("event_id").cast("string").alias("EventID"),
        F.struct(F.concat(stamp, F.lit("0Z")).alias("_SystemTime")).alias("TimeCreated"),
        F.col("hostname").alias("Computer"),
    )
    fields = F.filter(
        F.array(
            data("TargetUserName", F.col("username")),
            data("ProcessName", F.col("process_name")),
            data("ProcessId", pid),
            data("CommandLine", F.col("command_line")),
        ),
        lambda d: d["_VALUE"].isNotNull() & (d["_VALUE"] != ""),
    )
    return rows.select(
        system.alias("System"), F.struct(fields.alias("Data")).alias("EventData")
    )


def write_xml(rows, path):
    (
        xml_rows(rows)
        .write.mode("append")
        .format("xml")
        .option("rootTag", "Events")
        .option("rowTag", "Event")
        .save(path)
    )


@query(
    "windows_xml_parse",
    f"""WITH {HOSTK_SQL} SELECT event_id, epoch_us(ts) AS ts_us, hostname, username,
      nullif(process_name, '') AS process_name, process_id, nullif(command_line, '') AS command_line FROM hostk""",
)
def windows_xml_parse(spark, sf):
    """Events written as XML files and read back; half the process ids are hex."""
    path = scratch_path(spark, "xml")
    write_xml(host_rows(spark, sf), path)
    out = logs.read_xml_events(spark, path, F.lit(YEAR), created_at(), "*.xml")
    return out.select(
        F.get_json_object("raw_data", "$.event_id").cast("long").alias("event_id"),
        micros_or_null(), "hostname", "username", "process_name", "process_id", "command_line",
    )


@query(
    "log_directory_scan",
    f"""WITH {HOSTK_SQL}, s AS (
      SELECT 'text' AS kind, hostname FROM hostk WHERE k % 10 <> 9
      UNION ALL SELECT 'json', hostname FROM hostk WHERE {JSON_WHERE}
      UNION ALL SELECT 'xml', hostname FROM hostk)
    SELECT kind, hostname, count(*) AS n_events FROM s GROUP BY kind, hostname""",
)
def log_directory_scan(spark, sf):
    """One folder with text, JSON and XML logs, read together."""
    path = scratch_path(spark, "logs")
    rows = host_rows(spark, sf)
    syslog_lines(rows).select("line").write.mode("append").text(path)
    # The JSON reader takes lines as they are, so they are written as text there too.
    json_lines(rows).select(F.col("line").alias("value")).write.mode("append").option(
        "extension", "json"
    ).option("quote", "").option("escapeQuotes", "false").option("sep", "\u0001").csv(path)
    write_xml(rows, path)
    out = logs.read_log_directory(spark, path, F.lit(YEAR), created_at(), text_glob="*.txt")
    kind = (
        F.when(F.col("source").endswith(".txt"), "text")
        .when(F.col("source").endswith(".xml"), "xml")
        .otherwise("json")
    )
    return out.groupBy(kind.alias("kind"), "hostname").agg(F.count(F.lit(1)).alias("n_events"))


FLAGS_SQL = """CASE WHEN protocol = 'TCP' THEN
  CASE tcp_flags WHEN 'S' THEN 'S' WHEN 'SA' THEN 'SA' WHEN 'FA' THEN 'FA' WHEN 'R' THEN 'R' WHEN 'PA' THEN 'PA' ELSE '' END END"""


@query(
    "capture_decode",
    f"""WITH n AS (SELECT {", ".join(f"{e} AS {a}" for a, e in NET.items())}, k, user_id
      FROM (SELECT event_id, ts, user_id, event_type AS raw_type, value, {K} AS k FROM events))
    SELECT epoch_us(ts) AS ts_us, CASE WHEN contains(dst_ip, ':') THEN 'fd00::' || (user_id % 9999 + 1) ELSE src_ip END AS src_ip,
      dst_ip, CASE WHEN protocol IN ('TCP', 'udp') THEN src_port END AS src_port,
      CASE WHEN protocol IN ('TCP', 'udp') THEN dst_port END AS dst_port,
      CASE WHEN contains(dst_ip, ':') AND protocol = 'ICMP' THEN 'ICMP' ELSE upper(protocol) END AS protocol,
      CAST(14 + CASE WHEN contains(dst_ip, ':') THEN 40 ELSE 20 END + k
        + CASE protocol WHEN 'TCP' THEN 20 WHEN 'udp' THEN 8 WHEN 'ICMP' THEN 8 ELSE 4 END AS BIGINT) AS bytes_sent,
      {FLAGS_SQL} AS tcp_flags FROM n WHERE dst_ip IS NOT NULL""",
)
def capture_decode(spark, sf):
    """Network events written as packet captures and decoded again."""
    rows = raw_events(spark, sf).selectExpr(
        *[f"{e} AS {a}" for a, e in NET.items()], "k", "user_id"
    )
    rows = rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    out = packet_events(packets(written(capture_files(rows), "captures")))
    return out.select(
        micros_or_null(), "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_sent",
        F.get_json_object("raw_data", "$.tcp_flags").alias("tcp_flags"),
    )


def _sql_case(value: str, cases: dict) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + " END"


@query(
    "capture_folder",
    f"""WITH n AS (SELECT {", ".join(f"{e} AS {a}" for a, e in NET.items())}, k, user_id
      FROM (SELECT event_id, ts, user_id, event_type AS raw_type, value, {K} AS k FROM events)),
    f AS (SELECT *, event_id // {EVENTS_PER_FILE} AS file, coalesce(contains(dst_ip, ':'), false) AS six FROM n),
    b AS (SELECT *, CASE WHEN file % 2 = 0 THEN 0 WHEN event_id % 5 = 1 THEN 2 WHEN event_id % 5 = 2 THEN 3 ELSE 6 END AS block
      FROM f),
    l AS (SELECT *, CASE WHEN block = 3 THEN {FACES[0]}
        WHEN block > 0 THEN {_sql_case(f"event_id % {len(FACES)}", {
            i: f"(CASE WHEN six THEN {229 if x == 228 else x} ELSE {228 if x == 229 else x} END)" for i, x in enumerate(FACES)})}
        ELSE {_sql_case(f"(file // 2) % {len(LINKS)}", dict(enumerate(LINKS)))} END AS link,
      coalesce(last_value(CASE WHEN block <> 3 THEN epoch_us(ts) END IGNORE NULLS) OVER (
        PARTITION BY file ORDER BY event_id), 0) AS ts_us,
      max(event_id) OVER (PARTITION BY file) AS last_id FROM b)
    SELECT 'packet' AS kind, ts_us, CASE WHEN six THEN 'fd00::' || (user_id % 9999 + 1) ELSE src_ip END AS src_ip, dst_ip,
      CASE WHEN protocol IN ('TCP', 'udp') THEN src_port END AS src_port,
      CASE WHEN protocol IN ('TCP', 'udp') THEN dst_port END AS dst_port, upper(protocol) AS protocol,
      CAST({_sql_case("link", HEADERS)} + CASE WHEN link = 1 THEN 4 * (event_id % 3) ELSE 0 END
        + CASE WHEN six THEN 40 ELSE 20 END + k
        + CASE protocol WHEN 'TCP' THEN 20 WHEN 'udp' THEN 8 WHEN 'ICMP' THEN 8 ELSE 4 END AS BIGINT) AS bytes_sent,
      {FLAGS_SQL} AS tcp_flags, CAST(NULL AS VARCHAR) AS error
    FROM l WHERE dst_ip IS NOT NULL AND NOT (file = {CUT_FILE} AND event_id = last_id)
    UNION ALL SELECT 'error', NULL, NULL, NULL, NULL, NULL, NULL, size, NULL, error
    FROM (VALUES (CAST(0 AS BIGINT), 'empty.pcap: empty file'), (50, 'foreign.pcapng: not a capture')) e(size, error)
    UNION ALL SELECT 'error', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{CUT_FILE}.pcapng: cut off in a record'
    FROM (SELECT 1 FROM events WHERE event_id // {EVENTS_PER_FILE} = {CUT_FILE} LIMIT 1)""",
)
def capture_folder(spark, sf):
    """A folder of captures of all link types, read in ranges of 50 kB, and what could not be read."""
    rows = raw_events(spark, sf).selectExpr(*[f"{e} AS {a}" for a, e in NET.items()], "k", "user_id")
    rows = rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")
    folder = scratch_path(spark, "capture-folder")
    write_capture_folder(rows, folder)
    found, errors = read_packets(spark, folder, every=50_000)
    events = packet_events(found).select(
        F.lit("packet").alias("kind"), micros_or_null(), "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "bytes_sent",
        F.get_json_object("raw_data", "$.tcp_flags").alias("tcp_flags"),
    )
    name = F.substring_index("path", "/", -1)
    errors = errors.select(
        F.lit("error").alias("kind"),
        # How long the cut one is depends on how it was written.
        F.when(~name.startswith(f"{CUT_FILE}."), F.col("size")).alias("bytes_sent"),
        F.concat(name, F.lit(": "), "error").alias("error"),
    )
    return events.unionByName(errors, allowMissingColumns=True)


@query(
    "ioc_type_detect",
    """WITH v AS (
      SELECT url AS v FROM pages UNION ALL SELECT regexp_extract(url, '^https?://([^/?#:]+)', 1) FROM pages
      UNION ALL SELECT md5(CAST(event_id AS VARCHAR)) FROM events
      UNION ALL SELECT md5(CAST(event_id AS VARCHAR)) || md5(CAST(user_id AS VARCHAR)) FROM events
      UNION ALL SELECT '10.0.' || user_id || '.1' FROM events UNION ALL SELECT c_name FROM customer
      UNION ALL SELECT props FROM events)
    SELECT CASE WHEN regexp_matches(v, '^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$') THEN 'ip'
      WHEN regexp_matches(v, '^[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?([.][a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$') THEN 'domain'
      WHEN regexp_matches(v, '^[a-fA-F0-9]{32}$') OR regexp_matches(v, '^[a-fA-F0-9]{64}$') THEN 'hash'
      WHEN starts_with(v, 'http://') OR starts_with(v, 'https://') THEN 'url' END AS ioc_type,
      CASE WHEN regexp_matches(v, '^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$') THEN 'ip'
      WHEN regexp_matches(v, '^[a-fA-F0-9]{32}$') OR regexp_matches(v, '^[a-fA-F0-9]{64}$') THEN 'hash'
      WHEN regexp_matches(v, '^[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?([.][a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$') THEN 'domain'
      WHEN starts_with(v, 'http://') OR starts_with(v, 'https://') THEN 'url' END AS fixed_type, count(*) AS n
    FROM v GROUP BY 1, 2""",
)
def ioc_type_detect(spark, sf):
    out = indicator_values(spark, sf).select(
        indicator_type(F.col("line")).alias("ioc_type"),
        indicator_type(F.col("line"), hash_first=True).alias("fixed_type"),
    )
    return out.groupBy("ioc_type", "fixed_type").agg(F.count(F.lit(1)).alias("n"))


def indicator_values(spark, sf):
    """Addresses, hosts, URLs, digests and other text as feed lines."""
    events, pages = table(spark, sf, "events"), table(spark, sf, "pages")
    parts = [
        pages.select(F.col("url")),
        pages.select(F.regexp_extract("url", "^https?://([^/?#:]+)", 1)),
        events.select(F.md5(F.col("event_id").cast("string"))),
        events.select(
            F.concat(F.md5(F.col("event_id").cast("string")), F.md5(F.col("user_id").cast("string")))
        ),
        events.select(F.concat(F.lit("10.0."), F.col("user_id").cast("string"), F.lit(".1"))),
        table(spark, sf, "customer").select("c_name"),
        events.select("props"),
    ]
    out = parts[0].toDF("line")
    for p in parts[1:]:
        out = out.unionByName(p.toDF("line"))
    return out


@query(
    "line_feed_parse",
    """WITH v AS (SELECT url AS v FROM pages UNION ALL SELECT '# ' || url FROM pages
      UNION ALL SELECT '   10.0.' || (user_id % 250) || '.1 ' FROM events UNION ALL SELECT '' FROM events UNION ALL SELECT props FROM events)
    SELECT CASE WHEN starts_with(trim(v), '10.') THEN 'ip' ELSE 'url' END AS ioc_type, trim(v) AS value,
      CAST(0.6 AS DOUBLE) AS confidence, 'medium' AS severity, 'lines' AS source, count(*) AS n
    FROM v WHERE starts_with(trim(v), '10.') OR starts_with(v, 'http') GROUP BY ALL""",
)
def line_feed_parse(spark, sf):
    events, pages = table(spark, sf, "events"), table(spark, sf, "pages")
    lines = (
        pages.select(F.col("url").alias("line"))
        .unionByName(pages.select(F.concat(F.lit("# "), F.col("url")).alias("line")))
        .unionByName(
            events.select(
                F.concat(
                    F.lit("   10.0."), (F.col("user_id") % 250).cast("string"), F.lit(".1 ")
                ).alias("line")
            )
        )
        .unionByName(events.select(F.lit("").alias("line")))
        .unionByName(events.select(F.col("props").alias("line")))
    )
    out = feeds.line_feed(lines, "lines")
    return out.groupBy("ioc_type", "value", "confidence", "severity", "source").agg(
        F.count(F.lit(1)).alias("n")
    )


def blacklist_lines(spark, sf):
    text = F.when(F.col("k") % 10 == 0, F.lit("# comment, ignored")).when(
        F.col("k") % 10 == 1, F.lit("no-comma")
    ).otherwise(
        F.concat(
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"),
            F.lit(", 203.0.113."), F.col("k").cast("string"), F.lit(" ,443"),
        )
    )
    return raw_events(spark, sf).select(text.alias("line"))


@query(
    "blacklist_feed_parse",
    f"""SELECT 'ip' AS ioc_type, '203.0.113.' || k AS value, 'c2' AS threat_type, CAST(0.8 AS DOUBLE) AS confidence,
      'high' AS severity, 'abuse_ch' AS source, 'SSL Blacklist - C2 server' AS description, count(*) AS n
    FROM (SELECT {K} AS k FROM events) WHERE k % 10 > 1 GROUP BY ALL""",
)
def blacklist_feed_parse(spark, sf):
    out = feeds.blacklist_feed(blacklist_lines(spark, sf))
    return out.groupBy(
        "ioc_type", "value", "threat_type", "confidence", "severity", "source", "description"
    ).agg(F.count(F.lit(1)).alias("n"))


def domain_rows(spark, sf):
    return raw_events(spark, sf).select(
        F.when(F.col("k") % 9 != 0, F.concat(F.lit("d"), F.col("user_id").cast("string"), F.lit(".example"))).alias("Domain"),
        F.when(F.col("k") % 2 == 0, F.lit("phishing")).alias("threat_type"),
    )


def write_csv(df, path):
    df.write.option("header", True).csv(path)


@query(
    "csv_feed_parse",
    f"""SELECT 'domain' AS ioc_type, 'd' || user_id || '.example' AS value,
      CASE WHEN k % 2 = 0 THEN 'phishing' END AS threat_type, 'medium' AS severity, 'csvfeed' AS source, count(*) AS n
    FROM (SELECT user_id, {K} AS k FROM events) WHERE k % 9 <> 0 GROUP BY ALL""",
)
def csv_feed_parse(spark, sf):
    """A CSV feed written to files and read back; rows without a value drop out."""
    path = scratch_path(spark, "feed")
    write_csv(domain_rows(spark, sf), path)
    out = feeds.read_feeds(spark, [feeds.Feed("csvfeed", "https://feeds.example/list.csv", path)])
    return out.groupBy("ioc_type", "value", "threat_type", "severity", "source").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "feed_refresh_counts",
    f"""WITH e AS (SELECT user_id, {K} AS k FROM events), r AS (
      SELECT 'abuse_ch' AS source, 'ip' AS t, '203.0.113.' || k AS v FROM e WHERE k % 10 > 1
      UNION ALL SELECT 'csvfeed', 'domain', 'd' || user_id || '.example' FROM e WHERE k % 9 <> 0
      UNION ALL SELECT 'lines', 'url', url FROM pages),
    f AS (SELECT unnest(['abuse_ch', 'csvfeed', 'lines', 'empty', 'gone']) AS source)
    SELECT f.source, count(v) AS n_rows, count(DISTINCT v) AS n_indicators FROM f LEFT JOIN r ON r.source = f.source GROUP BY 1""",
)
def feed_refresh_counts(spark, sf):
    """Feeds landed as files, one of them empty and one missing, stored and folded."""
    base = scratch_path(spark, "feeds")
    blacklist_lines(spark, sf).write.text(f"{base}/black")
    write_csv(domain_rows(spark, sf), f"{base}/csv")
    table(spark, sf, "pages").select("url").write.text(f"{base}/lines")
    table(spark, sf, "pages").select("url").limit(0).write.text(f"{base}/empty")
    counts = feeds.refresh_feeds(
        spark,
        [
            feeds.Feed("abuse_ch", "https://feeds.example/a", f"{base}/black"),
            feeds.Feed("gone", "https://feeds.example/g", f"{base}/gone"),
            feeds.Feed("empty", "https://feeds.example/e", f"{base}/empty"),
            feeds.Feed("csvfeed", "https://feeds.example/b.csv", f"{base}/csv"),
            feeds.Feed("lines", "https://feeds.example/c", f"{base}/lines"),
            feeds.Feed("off", "https://feeds.example/d", f"{base}/none", enabled=False),
        ],
        f"{base}/indicators",
        created_at(),
    )
    counted = spark.createDataFrame(list(counts.items()), "source string, n_rows long")
    stored = current_iocs(spark.read.parquet(f"{base}/indicators"))
    folded = stored.groupBy("source").agg(F.count(F.lit(1)).alias("n_indicators"))
    return counted.join(folded, "source", "left").na.fill(0, ["n_indicators"])




@query(
    "dataset_flow_csv",
    """SELECT CASE WHEN l_returnflag = 'N' THEN 'BENIGN' ELSE l_returnflag END AS label, count(*) AS n,
      round(sum(l_quantity), 2) AS quantity, round(sum(l_tax) FILTER (l_linenumber NOT IN (2, 4)), 2) AS tax,
      count(*) FILTER (l_discount >= 0.05) AS n_discount, count(*) FILTER (l_linenumber = 2) AS n_nan,
      count(*) FILTER (l_linenumber = 4) AS n_infinite FROM lineitem GROUP BY 1""",
)
def dataset_flow_csv(spark, sf):
    """A labelled CSV set, whose label column name has a leading blank; missing
    numbers stay missing."""
    path = scratch_path(spark, "flowset")
    rows = table(spark, sf, "lineitem").select(
        "l_quantity",
        F.when(F.col("l_linenumber") == 2, "NaN")
        .when(F.col("l_linenumber") == 4, "Infinity")
        .otherwise(F.col("l_tax").cast("string"))
        .alias("l_tax"),
        F.when(F.col("l_discount") >= 0.05, F.col("l_discount")).alias(" l_discount"),
        F.when(F.col("l_returnflag") == "N", "BENIGN").otherwise(F.col("l_returnflag")).alias(" Label"),
    )
    # Three forms of header, in forty files.
    for number, order in enumerate(([0, 1, 2, 3], [3, 0, 2, 1], [2, 3, 1, 0])):
        part = rows.where(F.pmod(F.xxhash64("l_quantity", "` Label`", "l_tax"), F.lit(3)) == number)
        # Dealt by their values: dealing in turn would sort all rows of a task first.
        part = part.repartition(14 - number, *[F.col(f"`{c}`") for c in rows.columns]).select(*[f"`{rows.columns[i]}`" for i in order])
        part.write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", "false").csv(path)
    out = datasets.flow_csv_set(spark, [path])
    return out.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.sum(F.when(F.abs("l_tax") < float("inf"), F.col("l_tax"))), 2).alias("tax"),
        F.count("l_discount").alias("n_discount"),
        F.count_if(F.isnan("l_tax")).alias("n_nan"),
        F.count_if(F.col("l_tax") == float("inf")).alias("n_infinite"),
    )


@query(
    "dataset_headerless",
    """SELECT CASE l_returnflag WHEN 'N' THEN 'normal' ELSE 'neptune' END AS label, l_linestatus AS flag, count(*) AS n,
      CAST(sum(l_orderkey) AS DOUBLE) AS duration, CAST(sum(l_partkey) AS DOUBLE) AS dst_host_srv_rerror_rate
    FROM lineitem GROUP BY 1, 2""",
)
def dataset_headerless(spark, sf):
    """The 43-column set without header."""
    path = scratch_path(spark, "kddset")
    text = {"protocol_type": F.lit("tcp"), "service": F.lit("http"), "flag": F.col("l_linestatus")}
    special = {
        "duration": F.col("l_orderkey"),
        "dst_host_srv_rerror_rate": F.col("l_partkey"),
        "label": F.when(F.col("l_returnflag") == "N", "normal").otherwise("neptune"),
    }
    rows = table(spark, sf, "lineitem").select(
        *[
            (special.get(c) if c in special else text.get(c, F.col("l_quantity"))).alias(c)
            for c in datasets.KDD_COLUMNS
        ]
    )
    rows.write.csv(path)
    out = datasets.kdd_set(spark, path)
    return out.groupBy("label", "flag").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("duration").alias("duration"),
        F.sum("dst_host_srv_rerror_rate").alias("dst_host_srv_rerror_rate"),
    )


@query(
    "dataset_labelled_csv",
    """SELECT CAST(toxic AS VARCHAR) AS label, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars,
      CAST(0 AS INT) AS has_attack_cat FROM documents JOIN labels USING (doc_id) GROUP BY toxic""",
)
def dataset_labelled_csv(spark, sf):
    """A header CSV with a 0/1 label and an attack category that is dropped."""
    path = scratch_path(spark, "labelled")
    rows = (
        table(spark, sf, "documents")
        .join(table(spark, sf, "labels"), "doc_id")
        .select(
            F.col("doc_id").alias("id"), "n_chars", "lang", F.lit("x").alias("attack_cat"),
            F.col("toxic").alias("label"),
        )
    )
    write_csv(rows, path)
    out = datasets.labelled_csv_set(spark, path)
    return (
        out.groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("n_chars").cast("long")).alias("n_chars"))
        .withColumn("has_attack_cat", F.lit(int("attack_cat" in out.columns)))
    )


@query(
    "sample_by_hash",
    "SELECT event_id, user_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 777",
)
def sample_by_hash(spark, sf):
    return sample_rows(table(spark, sf, "events"), "event_id", 777).select("event_id", "user_id")


@query(
    "union_missing_columns",
    """SELECT label, count(*) AS n, count(a) AS n_a, count(b) AS n_b, round(sum(a), 2) AS a FROM (
      SELECT o_orderpriority AS label, o_totalprice AS a, NULL AS b FROM orders
      UNION ALL SELECT p_brand, NULL, p_size FROM part) GROUP BY label""",
)
def union_missing_columns(spark, sf):
    """Two header CSVs with different columns, read as one set."""
    base = scratch_path(spark, "flowsets")
    left = table(spark, sf, "orders").select(
        F.col("o_totalprice").alias(" a"), F.col("o_orderpriority").alias(" Label")
    )
    right = table(spark, sf, "part").select(F.col("p_size").alias(" b"), F.col("p_brand").alias("Label"))
    for name, rows in (("orders", left), ("part", right)):
        rows.write.option("header", True).csv(f"{base}/{name}")
    both = datasets.flow_csv_set(spark, [f"{base}/orders", f"{base}/part"])
    return both.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count("a").alias("n_a"), F.count("b").alias("n_b"),
        F.round(F.sum("a"), 2).alias("a"),
    )


@query(
    "event_rows",
    f"""WITH {NET_SQL}, {HOST_SQL} SELECT event_id, 'network' AS event_type, src_ip, dst_port, bytes_sent,
      CAST(NULL AS VARCHAR) AS hostname, CAST(NULL AS VARCHAR) AS command_line,
      coalesce(bytes_sent, 0) + coalesce(bytes_received, 0) AS total_bytes, CAST(NULL AS INT) AS cmd_has_pipe FROM net
    UNION ALL SELECT event_id, 'host', NULL, NULL, NULL, hostname, command_line, NULL,
      CAST(contains(coalesce(command_line, ''), '|') AS INT) FROM host""",
)
def event_rows(spark, sf):
    """Network and host events in one layout; absent fields are NULL."""
    return all_events(spark, sf).select(
        "event_id", "event_type", "src_ip", "dst_port", "bytes_sent", "hostname", "command_line",
        "features.total_bytes", "features.cmd_has_pipe",
    )


@query(
    "event_sink_by_day",
    f"""WITH {NET_SQL}, {HOST_SQL}, e AS (SELECT event_type, ts, event_id FROM net UNION ALL SELECT event_type, ts, event_id FROM host)
    SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids
    FROM e GROUP BY ALL""",
)
def event_sink_by_day(spark, sf):
    """Events stored by day and type, and read back."""
    path = scratch_path(spark, "events")
    sinks.write_events(all_events(spark, sf), path)
    stored = sinks.read_events(spark, path)
    return stored.groupBy(F.col("event_date").cast("string").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
    )


@query(
    "alert_sink_idempotent",
    f"""WITH {NET_SQL}, {HOST_SQL}, {PATTERN_SQL} SELECT {_names_sql("signature_id", NAMES)} AS title, count(*) AS n_alerts
    FROM pat GROUP BY 1""",
)
def alert_sink_idempotent(spark, sf):
    """Alerts stored twice are there once."""
    path = scratch_path(spark, "alerts")
    patterns = [r for r in ALL_RULES if r.rule_type == "pattern"]
    for _ in range(2):
        sinks.write_alerts(detect(all_events(spark, sf), patterns, created_at()), path)
    return spark.read.parquet(path).groupBy("title").agg(F.count(F.lit(1)).alias("n_alerts"))
