"""Schemas of payloads, hits and the small tables beside them."""

from __future__ import annotations

#: What a tracker posts, one JSON object a line, with what the server adds.
PAYLOAD = (
    "n string, name string, u string, url string, d string, domain string, r string, referrer string, h int, hashMode int, "
    "m map<string,string>, meta map<string,string>, p map<string,string>, props map<string,string>, ts bigint, "
    "remote_ip string, user_agent string, headers map<string,string>, received_at timestamp_ntz"
)

#: A hit after enrichment. ``seq`` orders hits of one instant.
HIT = (
    "domain string, id bigint, seq bigint, ts timestamp_ntz, view boolean, event string, page string, host string, "
    "browser string, browser_version string, os string, os_version string, device string, country string, "
    "subdivision1_code string, subdivision2_code string, city int, source string, referrer string, "
    "utm_campaign string, utm_content string, utm_medium string, utm_source string, utm_term string"
)

#: Columns that a breakdown may group by.
PROPERTIES = (
    "event", "page", "host", "entry_page", "exit_page", "source", "referrer", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
    "browser", "browser_version", "os", "os_version", "device", "country", "subdivision1_code", "city",
)

SITE = "domain string, public boolean, goals array<struct<name:string,path:string>>"
