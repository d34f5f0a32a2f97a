"""Hosts and paths of URLs, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::[0-9]*)?(/[^?#]*)?"


def host_of(url: Column) -> Column:
    """The host in small letters, without user, port, a leading ``www.`` and a final dot; null if there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"^www\.(?=.*\.)|\.$", "")
    return F.when(host != "", host)


def path_of(url: Column, depth: int = 1) -> Column:
    """The first ``depth`` folders of the path (``/`` for the root); what follows the last slash is no folder."""
    folders = F.slice(F.split(F.regexp_extract(url, _URL, 2), "/"), 2, 1 << 20)
    inner = F.slice(folders, 1, F.greatest(F.lit(0), F.size(folders) - 1))
    return F.when(host_of(url).isNotNull(), F.concat(F.lit("/"), F.array_join(F.slice(inner, 1, depth), "/")))
