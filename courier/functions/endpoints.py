"""``host:port`` endpoints: split at the first colon, a missing or empty port takes the default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the default Kafka broker port.
DEFAULT_PORT = 9092


def host(endpoint: Column) -> Column:
    return F.substring_index(endpoint, ":", 1)


def port(endpoint: Column, default_port: int = DEFAULT_PORT) -> Column:
    """Port as INT; empty → default, not a number → NULL."""
    has = F.instr(endpoint, ":") > 0
    txt = F.when(has, F.substring(endpoint, F.instr(endpoint, ":") + 1, F.lit(1 << 30))).otherwise(F.lit(""))
    return F.when(txt == "", F.lit(default_port)).otherwise(txt.try_cast("int"))


def url_authority(url: Column) -> Column:
    """``scheme://[user@]host[:port]/…`` → ``host[:port]``."""
    auth = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(auth, r"^.*@", "")
