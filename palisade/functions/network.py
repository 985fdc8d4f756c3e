"""Column functions for network fields."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol numbers and their names.
PROTOCOL_NAMES = {
    1: "ICMP",
    6: "TCP",
    17: "UDP",
    41: "IPv6",
    47: "GRE",
    50: "ESP",
    51: "AH",
    58: "ICMPv6",
}

# Destination ports of each service flag.
SERVICE_PORTS = {
    "http": [80, 8080],
    "https": [443, 8443],
    "ssh": [22],
    "ftp": [21],
    "dns": [53],
    "smtp": [25, 587],
    "telnet": [23],
    "rdp": [3389],
    "smb": [445, 139],
}


def protocol_name(number: Column) -> Column:
    """Name of an IP protocol number; an unknown number stays as text."""
    names = F.create_map(*[F.lit(x) for pair in PROTOCOL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, number.cast("int")), number.cast("string"))


def is_private_ip(ip: Column) -> Column:
    """1 for an IPv4 address in 10/8, 172.16/12, 192.168/16 or 127/8, else 0."""
    parts = F.split(ip, "[.]")
    first = F.get(parts, F.lit(0)).try_cast("int")
    second = F.get(parts, F.lit(1)).try_cast("int")
    inside = (
        (first == 10)
        | ((first == 172) & second.between(16, 31))
        | ((first == 192) & (second == 168))
        | (first == 127)
    )
    ok = (F.size(parts) == 4) & second.isNotNull() & inside
    return F.coalesce(ok, F.lit(False)).cast("int")


def service_flag(service: str, dst_port: Column) -> Column:
    return dst_port.isin(SERVICE_PORTS[service]).cast("int")
