"""Text, time and record normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of what is redacted, and what stands for it.
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
DATE = r"\b\d{4}-\d{2}-\d{2}\b"


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def hostname(x: Column, suffix: str = ".SYSTEMIA.COM") -> Column:
    """Without white space, upper case, the domain suffix cut off."""
    bare = F.upper(F.regexp_replace(x, r"\s+", ""))
    return F.when(F.endswith(bare, F.lit(suffix)), F.substr(bare, F.lit(1), F.length(bare) - len(suffix))).otherwise(bare)


def truncated(x: Column, n: int) -> Column:
    """At most n characters; a longer text ends in three dots."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 3), F.lit("..."))).otherwise(x)


def redacted(x: Column, n: int = 300) -> Column:
    """Cut to n characters; UUIDs and dates replaced; empty texts become null."""
    y = F.regexp_replace(F.regexp_replace(F.substring(x, 1, n), UUID, "<GUID>"), DATE, "<DATE>")
    return F.when(F.trim(y) != "", y)


def words(x: Column) -> Column:
    """Runs of letters, digits, underscores and hyphens, lower case."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"((?U)[\w-]+)"), 1)


def token_estimate(x: Column) -> Column:
    """One token for four bytes begun, at least one."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(x) + 3) / 4)).cast("long")


def non_negative(x: Column) -> Column:
    return F.when(x >= 0, x)


def iso_millis(x: Column) -> Column:
    """Epoch milliseconds of an ISO-8601 time with an offset or Z, fraction of any length; null without an offset."""
    t = F.trim(x)
    head = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})", 1)
    clock = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})", 2)
    fraction = F.rpad(F.regexp_extract(t, r"^[^.]*\.(\d{1,6})\d*", 1), 6, "0")
    zone = F.regexp_extract(t, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    zone = F.when(zone == "Z", F.lit("+00:00")).otherwise(F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
    good = (head != "") & (F.regexp_extract(t, r"(Z|[+-]\d{2}:?\d{2})$", 1) != "")
    return F.when(good, F.unix_millis(F.try_to_timestamp(F.concat(head, F.lit("T"), clock, F.lit("."), fraction, zone), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))))


def window_index(ms: Column, minutes: int) -> Column:
    return F.floor(ms / (minutes * 60000)).cast("long")


def group_id(document: Column, file: Column, host: Column, ms: Column) -> Column:
    """The unit that a split never divides: the document, else the host's half hour in its file."""
    return F.coalesce(F.concat(F.lit("document:"), document), F.concat_ws(":", F.lit("incident-window"), file, host, window_index(ms, 30).cast("string")))


def canonical_json(m: Column) -> Column:
    """A string map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def private_ipv4(x: Column) -> Column:
    """Private and unicast: 10/8, 172.16/12, 192.168/16; nothing else, and no loopback."""
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    return F.coalesce(x.rlike(rf"^(?:10\.{octet}\.{octet}\.{octet}|172\.(?:1[6-9]|2\d|3[01])\.{octet}\.{octet}|192\.168\.{octet}\.{octet})$"), F.lit(False))


def host_codes(x: Column, prefix: str = "sysclient") -> Column:
    """The numbers of all hosts that a text names, four digits each, in order."""
    return F.transform(F.regexp_extract_all(F.lower(x), F.lit(prefix + r"(\d{1,4})"), 1), lambda n: F.lpad(n, 4, "0"))


def allowed_properties(m: Column, allowed: tuple[str, ...], n: int = 500) -> Column:
    """Those properties of a string map that may be shown, cut to n characters, as JSON with sorted keys."""
    few = F.map_filter(m, lambda k, v: k.isin(*allowed))
    return canonical_json(F.transform_values(few, lambda k, v: F.substring(v, 1, n)))


#: Parts of paths whose change matters; a parameter of sensitive_change.
PATH_MARKERS = ("\\system32\\", "\\startup\\", "\\tasks\\", "/etc/", "/cron")


def sensitive_change(kind: Column, action: Column, path: Column, acuity: Column, markers: tuple[str, ...] = PATH_MARKERS) -> Column:
    """Whether an event changes the registry, or, with an acuity of 3 or more, a file at a marked path."""
    registry = (kind == "REGISTRY") & action.isin("ADD", "EDIT", "REMOVE")
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(F.lower(path), F.lit(m))
    file = (kind == "FILE") & action.isin("CREATE", "WRITE", "MODIFY", "RENAME", "DELETE") & (F.coalesce(acuity, F.lit(0)) >= 3) & marked
    return F.coalesce(registry | file, F.lit(False))


def edge_weight(x: Column) -> Column:
    """(weight, relations) of an edge written as a number or as {"weight", "relation" or "relations"}; null if the weight isn't finite or is negative.

    Relations are distinct and sorted; without any there is 'default'.
    """
    w = F.coalesce(F.try_to_number(F.get_json_object(x, "$.weight"), F.lit("999999.999999")).cast("double"), F.get_json_object(x, "$.weight").try_cast("double"), x.try_cast("double"))
    many = F.from_json(F.get_json_object(x, "$.relations"), "array<string>")
    one = F.when(F.get_json_object(x, "$.relation").isNotNull(), F.array(F.get_json_object(x, "$.relation")))
    names = F.array_sort(F.array_distinct(F.filter(F.coalesce(many, one, F.array().cast("array<string>")), lambda r: r.isNotNull() & (r != ""))))
    fine = w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w < float("inf"))
    return F.when(fine, F.struct(w.alias("weight"), F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("default"))).alias("relations")))


def signatures(document: Column, values: dict[str, Column]) -> Column:
    """Entity signatures of an item, sorted: document:<id>, and <kind>:<value> of each value there is, without outer spaces, in lower case."""
    own = F.when(document.isNotNull(), F.array(F.concat(F.lit("document:"), document.cast("string")))).otherwise(F.array().cast("array<string>"))
    every = own
    for kind, value in values.items():
        v = F.lower(F.trim(value.cast("string")))
        every = F.concat(every, F.when(F.coalesce(v, F.lit("")) != "", F.array(F.concat(F.lit(kind + ":"), v))).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(every))
