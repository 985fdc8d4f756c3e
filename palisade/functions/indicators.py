"""Typing of threat indicators by their shape."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes, tried in this order.
IP_SHAPE = "^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}$"
LABEL = "[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
DOMAIN_SHAPE = f"^{LABEL}([.]{LABEL})*$"
HASH_SHAPE = "^([a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})$"
URL_SHAPE = "^https?://"


def indicator_type(value: Column, hash_first: bool = False) -> Column:
    """ip, domain, hash, url or NULL.

    The default order tries domains before hashes, so a 32- or 40-digit hash
    reads as a domain; ``hash_first`` corrects that.
    """
    ip, domain = value.rlike(IP_SHAPE), value.rlike(DOMAIN_SHAPE)
    digest, url = value.rlike(HASH_SHAPE), value.rlike(URL_SHAPE)
    if hash_first:
        return F.when(ip, "ip").when(digest, "hash").when(domain, "domain").when(url, "url")
    return F.when(ip, "ip").when(domain, "domain").when(digest, "hash").when(url, "url")


def url_host(url: Column) -> Column:
    """Host part of an http(s) URL, without port or user."""
    return F.lower(F.regexp_extract(url, "^https?://([^/?#:]+)", 1))
