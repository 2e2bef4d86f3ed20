"""URLs in one form, with their queries decoded and encoded again; `text.normal_url` is the column expression for plain ones."""

from __future__ import annotations

import html
import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import TRACKING


def _one(url: str | None) -> str | None:
    if url is None:
        return None
    u = urlsplit(url.strip())
    port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    kept = sorted((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if not re.match(TRACKING, f"{k.lower()}="))
    return urlunsplit(("https" if u.scheme in ("http", "https") else u.scheme, (u.hostname or "").lower() + port, u.path.rstrip("/"), urlencode(kept), ""))


@F.pandas_udf(StringType())
def exact_url(urls: pd.Series) -> pd.Series:
    return urls.map(_one)


@F.pandas_udf(StringType())
def clean_text(values: pd.Series) -> pd.Series:
    """Text without tags, all entities as characters, single blanks; null if nothing is left."""
    return values.map(lambda v: None if v is None else " ".join(html.unescape(re.sub(r"<[^>]*>", " ", v)).split()) or None)
