"""Structured log messages (RFC 5424) of rows; the transport is the caller's, as in `foreachBatch`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.operators.formats import Format

#: The enterprise number that RFC 5424 uses in its examples.
ENTERPRISE = "32473"
FACILITIES = {"kern": 0, "user": 1, "mail": 2, "daemon": 3, "auth": 4, "syslog": 5, "lpr": 6, "news": 7, "uucp": 8, "cron": 9, "authpriv": 10, "ftp": 11, **{f"local{k}": 16 + k for k in range(8)}}
SEVERITIES = {"emerg": 0, "alert": 1, "crit": 2, "err": 3, "warning": 4, "notice": 5, "info": 6, "debug": 7}


def priority(facility: str, severity: str) -> int:
    return FACILITIES[facility] * 8 + SEVERITIES[severity]


def syslog_messages(df: DataFrame, text: str, message_id: str | None, pri: int, time: Column, host: str = "-", app: str = "-", pid: int = 0, enterprise: str = ENTERPRISE, **options) -> DataFrame:
    """(line): each row in a format as one message: header, structured data, byte-order mark and the text without its last line break.

    A message_id that starts with `@` is a registered name and takes no enterprise number; without one it is `-`. A null
    time is `-`, as the standard has it.
    """
    if not 0 <= pri <= 191:
        raise ValueError(f"no such priority: {pri}")
    form = Format(text, color=False, **options)
    if message_id is None:
        name, mark = "-", "-"
    elif message_id.startswith("@"):
        mark = message_id[1:]
        name = mark.partition("@")[0]
    else:
        name, mark = message_id, f"{message_id}@{enterprise}"
    stamp = F.coalesce(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSxx"), F.lit("-"))
    data = F.rtrim(F.concat(F.lit(f"[{mark} "), form.render(df, "sdparams")))
    shown = F.regexp_replace(form.render(df, "text"), "\\n\\z", "")
    head = F.concat(F.lit(f"<{pri}>1 "), stamp, F.lit(f" {host} {app} {pid} {name} "))
    return df.select(F.concat(head, data, F.lit("] ﻿"), shown).alias("line"))
