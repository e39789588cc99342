"""URL and address functions on columns."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueloom.functions.text import SPACE, _col, strip

# Hosts and paths that serve video streams, and those that never do.
MEDIA_MARKS = ["zjcdn.com", "douyinvod.com", "bytecdn", "video/tos"]
NOT_MEDIA_MARKS = ["douyinstatic.com", "media-audio-"]
# How profile ids and links of the platform look.
OPAQUE_ID = "MS4wLjABAAAA"
SHORT_LINK_HOST = "v.douyin.com"
WORK_PAGE = "https://www.douyin.com/video/"


def extract_url(c: Column | str) -> Column:
    """First link inside share text, else the text itself."""
    found = F.regexp_extract(_col(c), r"https?://[a-zA-Z0-9.\-_/]+", 0)
    return F.coalesce(F.nullif(found, F.lit("")), strip(c))


def clean_url(c: Column | str) -> Column:
    """Link to download from: a word that is a link, a link inside text, or a bare domain."""
    raw = strip(F.coalesce(_col(c), F.lit("")))
    word = F.regexp_extract(raw, rf"(?:\A|{SPACE})(https?://(?:(?!{SPACE}).)*)", 1)
    inner = F.regexp_extract(raw, r"https?://\S+", 0)
    bare = F.when(raw.rlike(r"^([a-zA-Z0-9-]+\.)+[a-zA-Z]{2,}(/.*)?$"), F.concat(F.lit("https://"), raw))
    picked = F.coalesce(F.nullif(word, F.lit("")), F.nullif(inner, F.lit("")), bare, raw)
    edge = r"""[ ,.?!;:"'()\[\]<>]+"""
    return strip(F.regexp_replace(picked, rf"\A{edge}|{edge}\z", ""))


def work_id_from_url(c: Column | str) -> Column:
    url = _col(c)
    found = F.coalesce(
        F.nullif(F.regexp_extract(url, r"/(?:video|note|slides)/(\d+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(url, r"modal_id=(\d+)", 1), F.lit("")),
    )
    return F.struct(found.alias("work_id"), F.concat(F.lit(WORK_PAGE), found).alias("canonical_url"))


def is_media_url(url: Column | str, mime: Column | str | None = None) -> Column:
    low = F.lower(F.coalesce(_col(url), F.lit("")))
    kind = F.lower(F.coalesce(_col(mime), F.lit(""))) if mime is not None else F.lit("")
    served, barred = F.lit(False), F.lit(False)
    for mark in MEDIA_MARKS:
        served = served | low.contains(mark)
    for mark in NOT_MEDIA_MARKS:
        barred = barred | low.contains(mark)
    video = kind.contains("video") | low.contains("mime_type=video") | low.contains(".mp4")
    return low.rlike(r"\Ahttps?://") & ~barred & served & video


def media_url_score(url: Column | str) -> Column:
    """Sort key of a stream link: bitrate, then combined streams, then the longer link."""
    u = _col(url)
    # The first value of a repeated parameter counts; an empty one is no value.
    br = F.regexp_extract(u, r"[?&]br=([^&#]+)", 1)
    bt = F.regexp_extract(u, r"[?&]bt=([^&#]+)", 1)
    chosen = F.coalesce(F.nullif(br, F.lit("")), F.nullif(bt, F.lit("")), F.lit("0"))
    rate = F.coalesce(chosen.try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.struct(
        rate.alias("bitrate"),
        F.when(F.lower(u).contains("media-video-"), 0).otherwise(1).alias("combined"),
        F.length(u).alias("length"),
    )


def channel_ref(c: Column | str) -> Column:
    """What a channel input is: opaque id, profile link, short link or handle."""
    url = extract_url(strip(c))
    in_link = F.regexp_extract(url, rf"/user/({OPAQUE_ID}[a-zA-Z0-9_\-]+)", 1)
    opaque = url.startswith(OPAQUE_ID) & (F.length(url) > 30)
    kind = (
        F.when(opaque, "opaque_id")
        .when(in_link != "", "profile_link")
        .when(url.contains(SHORT_LINK_HOST), "short_link")
        .otherwise("handle")
    )
    value = (
        F.when(opaque, url)
        .when(in_link != "", in_link)
        .when(url.contains(SHORT_LINK_HOST), url)
        .otherwise(strip(F.replace(url, F.lit("@"), F.lit(""))))
    )
    return F.struct(kind.alias("kind"), value.alias("value"))


# IPv4 blocks that are not public, as first and last address.
_CLOSED_V4 = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "255.255.255.255"),
]


def ipv4_number(c: Column | str) -> Column:
    """Numeric value of a dotted address, NULL when it is not one."""
    parts = F.split(_col(c), r"\.")
    octets = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    shape = _col(c).rlike(r"\A(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}\z")
    number, valid = F.lit(0).cast("bigint"), shape
    for octet in octets:
        number = number * 256 + octet
        valid = valid & octet.between(0, 255)
    return F.when(valid, number)


def is_public_ipv4(c: Column | str) -> Column:
    """NULL for anything that is not a dotted IPv4 address."""
    number = ipv4_number(c)
    closed = F.lit(False)
    for first, last in _CLOSED_V4:
        closed = closed | number.between(int(ipaddress.IPv4Address(first)), int(ipaddress.IPv4Address(last)))
    return F.when(number.isNotNull(), ~closed)


@F.pandas_udf(T.BooleanType())
def _is_public_other(c: pd.Series) -> pd.Series:
    def check(text):
        try:
            ip = ipaddress.ip_address(text)
        except (ValueError, TypeError):
            return False
        closed = (ip.is_private, ip.is_loopback, ip.is_link_local, ip.is_multicast, ip.is_reserved, ip.is_unspecified)
        return not any(closed)

    return c.map(check).astype("bool")


def is_public_address(c: Column | str) -> Column:
    """IPv4 natively; only other notations need the address library."""
    return F.coalesce(is_public_ipv4(c), _is_public_other(_col(c)))
