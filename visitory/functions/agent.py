"""User agents: device, system and browser by short ordered rule tables of this package, and a bot test.

Rules are built into one CASE expression each. :func:`parsed` works them out row by row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import once

BOT = r"(?i)bot\b|bot/|crawl|spider|slurp|headless|lighthouse|facebookexternalhit|embedly|pingdom|monitor|curl/|wget/|python-requests|httpclient|go-http|java/|okhttp|scrapy|phantomjs|preview"
#: (pattern, name), first match wins.
DEVICES = (
    (r"iPad|Tablet|PlayBook|Silk/|Kindle|Nexus (?:7|9|10)|SM-T\d", "Tablet"),
    (r"Android(?!.*Mobile)", "Tablet"),
    (r"Mobi|iPhone|iPod|Windows Phone|BlackBerry|BB10|Opera Mini|IEMobile", "Mobile"),
    (r"SmartTV|SMART-TV|AppleTV|GoogleTV|HbbTV|PlayStation|Xbox|Nintendo|CrKey|Roku", "Desktop"),
    (r"Windows NT|Macintosh|X11|CrOS|Linux", "Desktop"),
)
#: (pattern, name, pattern of the version).
SYSTEMS = (
    (r"Windows Phone", "Windows Phone", r"Windows Phone(?: OS)? ([\d.]+)"),
    (r"Windows NT|Win64|Win32", "Windows", r"Windows NT ([\d.]+)"),
    (r"iPhone|iPad|iPod", "iOS", r"OS ([\d_]+) like"),
    (r"Macintosh|Mac OS X", "macOS", r"Mac OS X ([\d_.]+)"),
    (r"CrOS", "Chrome OS", r"CrOS \S+ ([\d.]+)"),
    (r"Android", "Android", r"Android ([\d.]+)"),
    (r"Ubuntu", "Ubuntu", r"Ubuntu/([\d.]+)"),
    (r"Linux|X11", "Linux", r"Linux ([\d.]+)"),
)
BROWSERS = (
    (r"Edg(?:e|A|iOS)?/", "Microsoft Edge", r"Edg(?:e|A|iOS)?/([\d.]+)"),
    (r"OPR/|Opera", "Opera", r"(?:OPR|Opera|Version)/([\d.]+)"),
    (r"SamsungBrowser/", "Samsung Browser", r"SamsungBrowser/([\d.]+)"),
    (r"YaBrowser/", "Yandex Browser", r"YaBrowser/([\d.]+)"),
    (r"Vivaldi/", "Vivaldi", r"Vivaldi/([\d.]+)"),
    (r"UCBrowser/", "UC Browser", r"UCBrowser/([\d.]+)"),
    (r"FxiOS/|Firefox/", "Firefox", r"(?:FxiOS|Firefox)/([\d.]+)"),
    (r"CriOS/|Chrome/|Chromium/", "Chrome", r"(?:CriOS|Chrome|Chromium)/([\d.]+)"),
    (r"Version/[\d.]+.*Safari/", "Safari", r"Version/([\d.]+)"),
    (r"MSIE |Trident/", "Internet Explorer", r"(?:MSIE |rv:)([\d.]+)"),
    (r"Thunderbird/", "Thunderbird", r"Thunderbird/([\d.]+)"),
    (r"Feedly|Feedbin|NewsBlur|NetNewsWire", "Feed reader", r"(?:Feedly|Feedbin|NewsBlur|NetNewsWire)/([\d.]+)"),
    (r"VLC/|iTunes/|QuickTime", "Media player", r"(?:VLC|iTunes|QuickTime)/([\d.]+)"),
)


def is_bot(agent: Column) -> Column:
    return F.coalesce(agent.rlike(BOT), F.lit(False))


def _first(agent: Column, rules, value) -> Column:
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(agent.rlike(rule[0]), value(rule)).otherwise(out)
    return out


def _version(agent: Column, rules) -> Column:
    found = _first(agent, rules, lambda r: F.regexp_extract(agent, r[2], 1))
    return F.nullif(F.translate(found, "_", "."), F.lit(""))


def device(agent: Column) -> Column:
    return _first(agent, DEVICES, lambda r: F.lit(r[1]))


def system(agent: Column) -> Column:
    return _first(agent, SYSTEMS, lambda r: F.lit(r[1]))


def system_version(agent: Column) -> Column:
    return _version(agent, SYSTEMS)


def browser(agent: Column) -> Column:
    return _first(agent, BROWSERS, lambda r: F.lit(r[1]))


def browser_version(agent: Column) -> Column:
    return _version(agent, BROWSERS)


def parsed(rows: DataFrame, agent_col: str = "user_agent") -> DataFrame:
    """``rows`` with device, os, os_version, browser, browser_version and bot, on a batch or a stream."""
    a = F.col(agent_col)
    kinds = [device(a).alias("device"), system(a).alias("os"), system_version(a).alias("os_version"), browser(a).alias("browser"), browser_version(a).alias("browser_version"), is_bot(a).alias("bot")]
    return once(rows, *rows.columns, *kinds)
