"""Column functions of ingest: visitor ids, hosts, referrers, sources, URL parts, client addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Headers that may name the client, in order; the remote address comes last. Fixed values.
ADDRESS_HEADERS = ("cf-connecting-ip", "b-forwarded-for", "x-real-ip", "x-forwarded-for", "x-client-ip", "fly-client-ip")
_ADDRESS = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*)$"


def filled(col: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(F.trim(col), F.lit(""))


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*map(filled, cols))


def visitor_id(address: Column, agent: Column, domain: Column, host: Column) -> Column:
    """CRC-32 of address, user agent, site and host, one after the other; nulls count as empty."""
    return F.crc32(F.concat(*[F.coalesce(c, F.lit("")) for c in (address, agent, domain, host)]).cast("binary"))


def clean_host(host: Column) -> Column:
    return F.regexp_replace(F.trim(host), r"^www\.", "")


def clean_domain(domain: Column) -> Column:
    """A site name as typed, without scheme, www. and slash, in lower case; null if it is no valid name."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(domain), r"^https?://", ""), r"^www\.", ""))
    bare = F.regexp_replace(bare, r"/+$", "")
    return F.when(bare.rlike(r"^[a-z0-9][a-z0-9_./:-]*$"), bare)


def first_domain(domains: Column) -> Column:
    return filled(F.split_part(domains, F.lit(","), F.lit(1)))


def once(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """``rows.select(*columns)`` with every column worked out once: the optimizer does not write its expression into
    each later use, as it does with projections. Row by row, on a batch and on a stream."""
    return rows.select(F.inline(F.array(F.struct(*columns))))


def clean_referrer(referrer: Column) -> Column:
    """With a scheme, without www. and one slash at the end, of its first 2,000 characters; null for direct traffic."""
    bare = filled(F.substring(referrer, 1, 2000))
    whole = F.when(bare.startswith("http"), bare).otherwise(F.concat(F.lit("https://"), bare))
    return F.regexp_replace(F.regexp_replace(whole, r"^(https?://)www\.", "$1"), r"/$", "")


def shown_referrer(referrer: Column) -> Column:
    return F.regexp_replace(referrer, r"^https?://", "")


def url_part(url: Column, part: str) -> Column:
    """HOST, PATH, QUERY, REF (the fragment) and so on; null for a malformed URL."""
    return F.try_parse_url(url, F.lit(part))


def url_query(url: Column, key: str) -> Column:
    return filled(F.try_parse_url(url, F.lit("QUERY"), F.lit(key)))


def query_value(query: Column, key: str) -> Column:
    """The value of a key in a URL's query part; null if there is none."""
    return filled(F.regexp_extract(query, f"(?:^|&){key}=([^&]*)", 1))


def page_path(url: Column, hash_mode: Column) -> Column:
    """The path ("/" if there is none), with the fragment where hash mode is on."""
    return page_of(url_part(url, "HOST"), url_part(url, "PATH"), url_part(url, "REF"), hash_mode)


def page_of(host: Column, path: Column, fragment: Column, hash_mode: Column) -> Column:
    path = F.coalesce(filled(path), F.when(host.isNotNull(), F.lit("/")))
    fragment = filled(fragment)
    return F.when((hash_mode == 1) & fragment.isNotNull(), F.concat(path, F.lit("#"), fragment)).otherwise(path)


def client_address(headers: Column, remote: Column, before: tuple[str, ...] = ()) -> Column:
    """The first filled header of ``before`` and ADDRESS_HEADERS (names in lower case), else the remote address without
    its port; "-" if invalid."""
    named = [filled(F.split_part(headers.getItem(h), F.lit(","), F.lit(1))) for h in (*before, *ADDRESS_HEADERS)]
    bare = F.regexp_replace(F.regexp_replace(F.trim(remote), r"^(\d+\.\d+\.\d+\.\d+):\d+$", "$1"), r"^\[(.*)\](?::\d+)?$", "$1")
    found = F.coalesce(*named, filled(bare), F.lit("-"))
    return F.when(found.rlike(_ADDRESS), found).otherwise("-")


def address_number(address: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    parts = F.split(address, r"\.")
    four = address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    number = reduce(lambda n, k: n * 256 + F.get(parts, F.lit(k)).cast("long"), range(4), F.lit(0).cast("long"))
    return F.when(four, number)
