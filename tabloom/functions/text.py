"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names whose values are masked, and what stands for them.
SENSITIVE = r"(?i)\b(password|senha|token|client[_-]?secret|secret|cookie|authorization)(\s*[:=]\s*)(?:bearer\s+)?[^\s,;]+"
BEARER = r"(?i)\bbearer\s+[^\s,;]+"
MASK = "[REDACTED]"


def sqlite_integer(text: Column) -> Column:
    """CAST(text AS INTEGER) of SQLite: the longest integer prefix after white space, else 0; beyond 64 bits the last that fits."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    beyond = F.when(digits.startswith("-"), F.expr("-9223372036854775807L - 1L")).when(digits != "", F.lit(9223372036854775807))
    return F.coalesce(digits.try_cast("bigint"), beyond, F.lit(0).cast("bigint"))


def nocase(text: Column) -> Column:
    """The key of COLLATE NOCASE: A-Z alone are folded."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalised(text: Column) -> Column:
    """Trimmed, lower-cased, with each run of white space as one space."""
    return F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")


def redacted(text: Column) -> Column:
    """Values of sensitive fields and bearer tokens masked."""
    return F.regexp_replace(F.regexp_replace(text, SENSITIVE, "$1$2" + MASK.replace("[", r"\[").replace("]", r"\]")), BEARER, "Bearer " + MASK)


def natural_key(text: Column, width: int = 20) -> Column:
    """A sort key in which runs of digits compare as numbers and the rest without case."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"\d+|\D+"), F.lit(0))
    padded = F.transform(pieces, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), width, "0")).otherwise(p))
    return F.array_join(padded, "")


def safe_stem(name: Column, default: str = "sheet") -> Column:
    """A file name's stem with runs of other characters than letters, digits, _, . and - as one _."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")
    clean = F.regexp_replace(F.regexp_replace(stem, r"(?U)[^\w.-]+", "_"), r"^_+|_+$", "")
    return F.when(clean == "", F.lit(default)).otherwise(clean)


def identity(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def identity_token(*parts: Column) -> Column:
    """24 hex digits of a digest of the parts under a separator that they don't hold."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 24)


def temporary_name(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)


def size_of(size: Column, length: Column) -> Column:
    """The size if it is digits only, else the length if that is, else null."""
    digits = lambda x: F.when(x.rlike(r"^\d+$"), x).try_cast("bigint")
    return F.coalesce(digits(size), digits(length))


def compact(text: Column, limit: int) -> Column:
    """White space folded; beyond the limit cut, with an ellipsis as the last character."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))).otherwise(flat)


def clock(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on."""
    s = F.floor(seconds).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    short = F.concat(two(m), F.lit(":"), two(F.pmod(s, F.lit(60))))
    return F.when(s < 3600, short).otherwise(F.concat(F.when(h < 10, two(h)).otherwise(h.cast("string")), F.lit(":"), short))


def odata_escape(path: Column) -> Column:
    return F.replace(path, F.lit("'"), F.lit("''"))


def scope_list(text: Column) -> Column:
    """Distinct non-empty parts of a list separated by semicolons, in their order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p != ""))


def json_value(envelope: Column) -> Column:
    """The list in a service's answer, in any of its shapes: value, d.results, d."""
    return F.coalesce(F.get_json_object(envelope, "$.value"), F.get_json_object(envelope, "$.d.results"), F.get_json_object(envelope, "$.d"))


def next_page(envelope: Column) -> Column:
    """The address of the next page, in any of its shapes."""
    return F.coalesce(*[F.get_json_object(envelope, p) for p in ("$['@odata.nextLink']", "$['odata.nextLink']", "$.d.__next", "$.__next")])


def site_of(url: Column) -> Column:
    """Scheme, host and port of an address, without case; null for what is none."""
    at = F.lower(F.regexp_extract(url, r"^(https?://[^/?#@\s]+)(?:[/?#]|$)", 1))
    return F.when(at != "", at)


def same_site(url: Column, site: Column) -> Column:
    """May an alternate address be used? Only if it is of the same site, and below its path."""
    path = F.concat(F.regexp_replace(F.lower(site), "/+$", ""), F.lit("/"))
    return F.coalesce((site_of(url) == site_of(site)) & F.lower(url).startswith(path), F.lit(False))


def version_url(site: Column, server_path: Column, version_id: Column) -> Column:
    """The address of a version's content; null unless the id is digits."""
    address = F.concat(F.regexp_replace(site, "/+$", ""), F.lit("/_api/web/GetFileByServerRelativePath(decodedurl='"), odata_escape(server_path), F.lit("')/Versions("), version_id, F.lit(")/$value"))
    return F.when(version_id.rlike(r"^[0-9]+$"), address)
