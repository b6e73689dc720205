"""Identities and shares: digests, split buckets, daily quotas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Offices with a quota of their own, by code or by a part of their name (fixed values).
LARGE_OFFICES = (("B10", "서울"), ("J10", "경기"))
LARGE_QUOTA, QUOTA = 50, 20


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def case_id(notice: Column, source: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", notice, source, index.cast("string")), 256)


def collected_id(notice: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("collected:"), notice), 256), 1, 32)


def revision_id(fingerprint: Column, sequence: Column) -> Column:
    return F.sha2(F.concat_ws(":", fingerprint, sequence.cast("string")), 256)


def split_of(group: Column) -> Column:
    """train, dev or eval by the first eight hex digits of the group's digest modulo 10."""
    bucket = F.conv(F.substring(F.sha2(group, 256), 1, 8), 16, 10).cast("bigint") % 10
    return F.when(bucket == 9, "eval").when(bucket == 8, "dev").otherwise("train")


def quota(code: Column, name: Column) -> Column:
    large = F.lit(False)
    for own, part in LARGE_OFFICES:
        large = large | (code == own) | name.contains(part)
    return F.when(large, LARGE_QUOTA).otherwise(QUOTA)


def object_path(sha: Column) -> Column:
    """Where an object lies by its digest; null unless the digest is one."""
    return F.when(sha.rlike("^[a-f0-9]{64}$"), F.concat_ws("/", F.lit("objects"), F.substring(sha, 1, 2), sha))


#: White space as Unicode has it, with the four separators below U+0020.
BLANK = r"[\s\p{Z}\x1C-\x1F\x85]"


def json_string(value: Column) -> Column:
    """A JSON string as canonical records hold it: quotes, backslashes and characters below U+0020 escaped, all others as they are."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    escaped = out
    for code in range(32):
        mark = F.decode(F.unhex(F.lit(f"{code:02x}")), "UTF-8")
        escaped = F.replace(escaped, mark, F.lit("\\" + short[code] if code in short else f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(value.rlike(r"[\x00-\x1F]"), escaped).otherwise(out), F.lit('"'))


def json_array(items: Column, quoted: bool = True) -> Column:
    """A JSON array of strings (or of values that are JSON already)."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, json_string) if quoted else items, ", "), F.lit("]"))


def json_object(**fields: Column) -> Column:
    """A JSON object of values that are JSON already, its keys in order."""
    parts = [x for i, k in enumerate(sorted(fields)) for x in (F.lit(f'{", " if i else "{"}"{k}": '), fields[k])]
    return F.concat(*parts, F.lit("}"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def notice_key(title: Column, html: Column, shas: Column) -> Column:
    """Digest of the canonical record of a notice: title, body without blanks between tags, sorted distinct assets."""
    body = F.regexp_replace(strip(html), rf">{BLANK}+<", "><")
    return F.sha2(json_object(assets=json_array(F.array_sort(F.array_distinct(shas))), html=json_string(body), title=json_string(strip(title))), 256)


def source_stamp(sha: Column, flags: Column, parser: Column, version: str, boundary: Column) -> Column:
    """Digest of what a file's classification rests on: content, flags, parser, rules, boundary. An override holds while it is equal."""
    return F.sha2(json_object(boundary=F.to_json(boundary), flags=F.to_json(flags), parser=json_string(F.coalesce(parser, F.lit(""))), sha=json_string(sha), version=json_string(F.lit(version))), 256)


def record_fingerprint(files: Column, version: str) -> Column:
    """Digest of a notice's classified files, in order of their ids, and the rules' version."""
    return F.sha2(json_object(files=F.to_json(F.array_sort(files)), version=json_string(F.lit(version))), 256)


def campaign_window(end: Column, years: float = 2) -> tuple[Column, Column]:
    """(seed, first day) of a campaign that looks back from its last day."""
    return F.substring(F.sha2(F.concat(F.lit("backfill:"), end.cast("string")), 256), 1, 16), F.date_sub(end, int(365.25 * years))
