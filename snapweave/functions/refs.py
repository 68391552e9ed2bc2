"""Column expressions over ref names, hashes, URLs and server messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADS, TAGS, REFS = "refs/heads/", "refs/tags/", "refs/"
#: What stands for an absent object, in both lengths of hashes.
ZEROS = ("0" * 40, "0" * 64)
#: Namespaces in which hosting services keep change requests (fixed values).
FOREIGN_PULL_PREFIXES = ("refs/pull/", "refs/pull-requests/", "refs/merge-requests/")
#: Parts of server messages (fixed values).
LEASE_MARKERS = ("stale info", "fetch first", "non-fast-forward", "does not match")
MOVE_MARKERS = ("remote ref has changed", "already exists", "stale info")
STAGING_PREFIX = "refs/snapweave/staging/heads/"


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for one in conditions:
        out = out | one
    return out


def ref_kind(ref: Column) -> Column:
    """branch, tag, other, or an empty string for names outside refs/."""
    return (
        F.when(ref.startswith(HEADS), "branch").when(ref.startswith(TAGS), "tag").when(ref.startswith(REFS), "other").otherwise("")
    )


def short_name(ref: Column) -> Column:
    """The name without refs/heads/, refs/tags/ or refs/."""
    return F.regexp_replace(ref, "^refs/(heads/|tags/)?", "")


def is_zero(value: Column) -> Column:
    """True for an absent or all-zero hash."""
    return value.isNull() | value.isin(*ZEROS)


def short_hash(value: Column) -> Column:
    return F.when(is_zero(value), "<zero>").otherwise(F.substring(value, 1, 8))


def excluded(ref: Column, prefixes: Sequence[str] = (), exact: Sequence[str] = ()) -> Column:
    """Whether a name begins with one of the prefixes or equals one of the names; blank entries count for nothing."""
    begins = [p.strip() for p in prefixes if p.strip()]
    names = [e.strip() for e in exact if e.strip()]
    return _any([*(ref.startswith(p) for p in begins), *([ref.isin(names)] if names else [])])


def foreign_pull(ref: Column) -> Column:
    return excluded(ref, FOREIGN_PULL_PREFIXES)


def action_for_target(target_hash: Column) -> Column:
    return F.when(is_zero(target_hash), "create").otherwise("update")


def staging_ref(target_ref: Column, prefix: str = STAGING_PREFIX) -> Column:
    """Where a branch is built up before it is cut over."""
    return F.concat(F.lit(prefix), short_name(target_ref))


def plan_line(action: Column, branch: Column, target_ref: Column, reason: Column) -> Column:
    label = F.when(F.coalesce(target_ref, F.lit("")) != "", target_ref).otherwise(branch)
    tail = F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit(" - "), reason)).otherwise("")
    return F.concat(F.upper(action), F.lit(" "), label, tail)


def human_bytes(n: Column) -> Column:
    """Powers of 1024 with two decimals below 10, one below 100, else none; ties go to the even digit."""
    return F.get(F.transform(F.array(n.cast("long")), _human), F.lit(0))  # a lambda, so that `n` is worked out once and the code stays small


def _human(n: Column) -> Column:
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    for power, suffix in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        unit = 1024**power

        def scaled(by: int, unit: int = unit) -> Column:
            low = n % unit * by
            cut, rest = div(n, unit) * by + div(low, unit), low % unit * 2
            return cut + F.when((rest > unit) | ((rest == unit) & (cut % 2 == 1)), 1).otherwise(0)

        places = lambda k: F.concat(div(scaled(10**k), 10**k).cast("string"), F.lit("."), F.lpad((scaled(10**k) % 10**k).cast("string"), k, "0"))
        digits = F.when(n >= 100 * unit, scaled(1).cast("string")).when(n >= 10 * unit, places(1)).otherwise(places(2))
        text = F.concat(digits, F.lit(f" {suffix}"))
        out = out.when(n < 1024 ** (power + 1), text) if power < 5 else out.otherwise(text)
    return out


def normalized_url(raw: Column) -> Column:
    """One spelling for one repository: lower-case scheme and host, no default port, user or closing slashes.

    Only http and https URLs change beyond trimming; blank input gives an empty string.
    """
    trimmed = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", ""), "/+$", "")
    pattern = r"^([A-Za-z]+)://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda k: F.regexp_extract(trimmed, pattern, k)
    scheme, host, port = F.lower(part(1)), F.lower(part(2)), part(3)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.regexp_replace(part(4), "/+$", "")
    query = F.when(part(5) == "?", "").otherwise(part(5))
    fragment = F.when(part(6) == "#", "").otherwise(part(6))
    whole = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), query, fragment)
    return F.when(scheme.isin("http", "https") & (host != ""), whole).otherwise(trimmed)


def same_repository(source: Column, target: Column) -> Column:
    a, b = normalized_url(source), normalized_url(target)
    return (a != "") & (a == b)


def redacted_url(url: Column) -> Column:
    """The URL without user information."""
    return F.regexp_replace(url, "//[^/@]*@", "//")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def owner_and_repo(url: Column) -> Column:
    """First two path parts without a closing .git, joined by a slash; empty unless there are exactly two."""
    found = F.regexp_extract(url, r"^[A-Za-z]+://[^/]+/([^/?#]+/[^/?#]+?)(?:\.git)?/?$", 1)
    return found


def split_list(text: Column) -> Column:
    """Comma-separated entries, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def parse_mapping(text: Column) -> Column:
    """struct(source, target) of `source:target` at the first colon; null unless both are there."""
    parts = F.split(text, ":", 2)
    source, target = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    return F.when((source != "") & (target != ""), F.struct(source.alias("source"), target.alias("target")))


def have_ref(text: Column) -> Column:
    """A full ref name; short names are branches."""
    name = F.trim(text)
    return F.when(name.startswith(REFS), name).otherwise(F.concat(F.lit(HEADS), name))


def token(text: Column) -> Column:
    """White-space runs become hyphens."""
    return F.regexp_replace(F.trim(text), r"\s+", "-")


def protocol_mode(mode: Column) -> Column:
    """auto, v1 or v2; blank is auto, anything else raises."""
    return F.when(F.coalesce(mode, F.lit("")) == "", "auto").when(mode.isin("auto", "v1", "v2"), mode).otherwise(F.raise_error(F.concat(F.lit("unsupported protocol mode "), mode)))


def hex_runs(text: Column) -> Column:
    """All runs of 7 to 40 hex digits that stand as words."""
    return F.regexp_extract_all(text, F.lit(r"(?i)\b[0-9a-f]{7,40}\b"), 0)


def header_count(header: Column) -> Column:
    """The big-endian 32-bit count in bytes 9 to 12 of a header."""
    return F.conv(F.hex(F.substring(header, 9, 4)), 16, 10).cast("long")


def lease_failure(status: Column) -> Column:
    return _any([F.lower(status).contains(x) for x in LEASE_MARKERS])


def concurrent_move(status: Column) -> Column:
    return _any([F.lower(status).contains(x) for x in MOVE_MARKERS])


def body_limit_error(message: Column) -> Column:
    low = F.lower(message)
    large = low.contains("too large")
    return low.contains("body exceeded size limit") | (low.contains("request body") & large) | (low.contains("payload") & large) | low.contains("http 413")


def deadline_error(message: Column) -> Column:
    return F.lower(message).contains("http 408") | F.lower(message).contains("http 504")


def body_limit(message: Column) -> Column:
    """The limit that a message announces, else 0."""
    found = F.regexp_extract(F.lower(message), "body exceeded size limit ([0-9]+)", 1)
    return F.coalesce(found.try_cast("long"), F.lit(0).cast("long"))


def report_has_error(report: Column) -> Column:
    """Whether a checker's report has a line that tells of real damage; dangling objects and warnings don't."""
    lines = F.transform(F.split(report, "\n"), lambda x: F.lower(F.regexp_replace(x, r"^\s+", "")))
    starts = ("error", "fatal", "missing ", "broken link", "bad ")
    return F.exists(lines, lambda x: _any([x.startswith(s) for s in starts]))


def short_host(host: Column, width: int = 30) -> Column:
    """A host name cut to `width`: its last two labels stay, with as much of the front as fits."""
    apex = F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1)
    room = F.lit(width - 1) - F.length(apex)
    front = F.concat(F.substring(host, F.lit(1), room), F.lit("…"), apex)
    cut = F.concat(F.substring(host, 1, max(width - 1, 0)), F.lit("…"))
    return F.when((F.length(host) <= width) | F.lit(width <= 0), host).when((apex != "") & (room >= 1), front).otherwise(cut)


def rate_text(size: Column, active_us: Column) -> Column:
    """Average bytes a second as text; `0 B/s` for spans under 50 ms and for nothing sent."""
    rate = (size.cast("double") / (active_us.cast("double") / F.lit(1e6))).cast("long")
    return F.when((active_us < 50_000) | (size <= 0), "0 B/s").otherwise(F.concat(human_bytes(rate), F.lit("/s")))


def epoch_time(text: Column) -> Column:
    """The time that an epoch in text names; blank or unreadable text is second 0."""
    return F.timestamp_seconds(F.coalesce(text.try_cast("long"), F.lit(0).cast("long")))
