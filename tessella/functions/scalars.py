"""Scalar expressions over catalogue values, all of them native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month ends never matter to day keys; an open end fills with 99.
OPEN = "99"


def day_key(text: Column, end: bool = False) -> Column:
    """``2026``, ``2026-09`` or ``2026-09-21`` as YYYYMMDD; parts that lack are 00, at a range's end 99."""
    digits = F.regexp_replace(text, "-", "")
    full = F.rpad(digits, 8, OPEN if end else "0")
    return F.when(text.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), full.cast("long"))


def slug(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def mask_emails(text: Column, mark: str = "[email]") -> Column:
    return F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", mark)


def has_contact(text: Column) -> Column:
    return text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def email_digest(address: Column) -> Column:
    return F.sha2(F.lower(F.trim(address)), 256)


def content_id(text: Column) -> Column:
    """Identifier of a file's content: sha1 over a length header and the bytes."""
    header = F.concat(F.lit("blob "), F.octet_length(text).cast("string"))
    return F.concat(F.lit("swh:1:cnt:"), F.sha1(F.concat(F.encode(header, "UTF-8"), F.unhex(F.lit("00")), F.encode(text, "UTF-8"))))


def shard(key: Column, n: int = 64) -> Column:
    """First byte of the key's sha256, modulo ``n``."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int") % n).cast("int")


def facet_token(code: str, value: Column) -> Column:
    """A short token for a facet's value, whatever its case and spacing."""
    norm = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
    return F.concat(F.lit("zz" + code), F.substring(F.sha1(norm), 1, 12))


def url_parts(url: Column) -> Column:
    """host (without www), first and second path segment of a web address."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1)), r"^www\.", "")
    path = F.regexp_extract(url, r"^https?://[^/?#]+/([^?#]*)", 1)
    return F.struct(host.alias("host"), F.split_part(path, F.lit("/"), F.lit(1)).alias("owner"), F.regexp_replace(F.split_part(path, F.lit("/"), F.lit(2)), r"\.git$", "").alias("name"))


def links(text: Column) -> Column:
    """All web addresses in a text, without closing punctuation."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s\"'<>]+"), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", ""))


def doi(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(text, r"(10\.\d{4,9}/[^\s\"<>]+)", 1), r"[.,;)\]]+$", ""))


def check_11_2(digits: Column) -> Column:
    """Whether 15 digits and a check character satisfy ISO 7064 mod 11-2."""
    total = F.aggregate(F.filter(F.split(F.substring(digits, 1, 15), ""), lambda d: d != ""), F.lit(0).cast("int"), lambda acc, d: (acc + d.cast("int")) * 2 % 11)
    check = (F.lit(12) - total) % 11
    return F.when(digits.rlike(r"^\d{15}[\dX]$"), F.when(check == 10, F.lit("X")).otherwise(check.cast("string")) == F.substring(digits, 16, 1)).otherwise(F.lit(False))


def semver_key(version: Column) -> Column:
    """A struct that sorts versions: numbers first, a release above its pre-releases, numeric
    pre-release parts below text, fewer parts below more; build metadata counts for nothing."""
    core = F.regexp_extract(version, r"^v?(\d+(?:\.\d+)*)", 1)
    number = F.transform(F.split(core, r"\."), lambda x: F.try_to_number(x, F.lit("9" * 18)).cast("long"))
    pre = F.regexp_extract(version, r"^v?[\d.]+-([0-9A-Za-z.-]+)", 1)
    parts = F.transform(F.split(pre, r"\."), lambda x: F.struct(F.when(x.rlike(r"^\d+$"), 0).otherwise(1).alias("k"), F.when(x.rlike(r"^\d+$"), F.lpad(x, 18, "0")).otherwise(x).alias("v")))
    return F.struct(number.alias("n"), F.when(pre == "", 1).otherwise(0).alias("final"), parts.alias("pre"))


def severity(score: Column) -> Column:
    return F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score > 0, "low").otherwise("none")


def package_name(name: Column) -> Column:
    """A package's name with runs of separators as one hyphen, in lower case."""
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))


def requirement(line: Column) -> Column:
    """Name, extras and version constraint of a requirement line."""
    rx = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[([^\]]*)\])?\s*([^;#]*)"
    return F.struct(package_name(F.regexp_extract(line, rx, 1)).alias("name"), F.regexp_extract(line, rx, 2).alias("extras"), F.trim(F.regexp_extract(line, rx, 3)).alias("constraint"))


def task_progress(text: Column) -> Column:
    """Done and all items of a task list."""
    return F.struct(F.regexp_count(text, F.lit(r"(?m)^\s*[-*] \[[xX]\]")).alias("done"), F.regexp_count(text, F.lit(r"(?m)^\s*[-*] \[[ xX]\]")).alias("total"))


def hidden_characters(text: Column) -> Column:
    """Number of bidirectional controls and zero-width characters."""
    return F.regexp_count(text, F.lit("[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{200B}-\\x{200F}]"))


def relative_time(seconds: Column) -> Column:
    def told(n: Column, unit: str) -> Column:
        k = F.floor(n).cast("string")
        return F.concat(k, F.lit(" " + unit), F.when(F.floor(n) == 1, "").otherwise("s"), F.lit(" ago"))

    return F.when(seconds < 60, "just now").when(seconds < 3600, told(seconds / 60, "minute")).when(seconds < 86400, told(seconds / 3600, "hour")).otherwise(told(seconds / 86400, "day"))


def count_condition(n: Column, condition: str) -> Column:
    """``3``, ``>=3``, ``<3``, ``1..5``, ``1..*`` as a predicate; another form matches nothing."""
    import re

    if m := re.fullmatch(r"(\d+)\.\.(\d+|\*)", condition):
        return (n >= int(m[1])) & (F.lit(True) if m[2] == "*" else n <= int(m[2]))
    if m := re.fullmatch(r"(>=|<=|>|<)?(\d+)", condition):
        k = F.lit(int(m[2]))
        return {">=": n >= k, "<=": n <= k, ">": n > k, "<": n < k}.get(m[1], n == k)
    return F.lit(False)


def date_condition(iso: Column, condition: str) -> Column:
    """``2026-01-01``, ``>=2026-01-01``, ``a..b`` on the day of an ISO time."""
    import re

    day = F.substring(iso, 1, 10)
    if ".." in condition:
        lo, hi = condition.split("..", 1)
        return (F.lit(True) if lo == "*" else day >= lo) & (F.lit(True) if hi == "*" else day <= hi)
    m = re.fullmatch(r"(>=|<=|>|<)?(.+)", condition)
    k = F.lit(m[2])
    return {">=": day >= k, "<=": day <= k, ">": day > k, "<": day < k}.get(m[1], day == k)


def license_family(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.rlike(r"agpl|affero"), "network copyleft").when(low.rlike(r"lgpl|mpl|lesser"), "weak copyleft").when(low.rlike(r"gpl|general public"), "copyleft")
        .when(low.rlike(r"apache|mit|bsd"), "permissive").when(low.rlike(r"cc by-nc"), "non-commercial").when(low.rlike(r"cc by"), "attribution").otherwise("unknown")
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def clean_url(url: Column) -> Column:
    """An address without the sentence's closing punctuation, closing brackets that nothing in
    it opens, invisible characters and escapes; one without a scheme gets https."""
    u = F.regexp_replace(F.regexp_replace(F.trim(url), "&amp;", "&"), r"[\s\x{200B}-\x{200F}\x{2060}\x{FEFF}]+", "")

    def step(u: Column, _: Column) -> Column:
        last = F.right(u, F.lit(1))
        extra = ((last == ")") & (F.regexp_count(u, F.lit(r"\(")) < F.regexp_count(u, F.lit(r"\)")))) | ((last == "]") & (F.regexp_count(u, F.lit(r"\[")) < F.regexp_count(u, F.lit(r"\]"))))
        return F.when(extra | last.isin(*".,;:!?'\"}>"), F.substring(u, F.lit(1), F.length(u) - 1)).otherwise(u)

    tail = F.length(F.regexp_extract(u, r"""([.,;:!?'"}>)\]]*)$""", 1))
    u = F.aggregate(F.sequence(F.lit(0), tail), u, step)
    return F.when(u.rlike(r"^(?i)[a-z][a-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))


def repository(url: Column) -> Column:
    """(repo, host, kind, owner, name) of an address of a code host; null for anything else.

    The repo key is in lower case, owner and name as written; sub-pages, ``.git`` and ``www.``
    count for nothing; SSH addresses are read as web addresses.
    """
    u = F.regexp_replace(clean_url(url), r"^(?i)(?:[a-z][a-z0-9+.-]*://)?git@([a-z0-9.-]+)[:/]/?", "https://$1/")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^(?i)https?://([a-z0-9.-]+)(?:[:/?#]|$)", 1)), r"^www\.", "")
    parts = F.filter(F.split(F.regexp_extract(u, r"^[^:]+://[^/?#]+/([^?#]*)", 1), "/"), lambda p: p != "")
    parts = F.when(host.startswith("gitlab."), F.split(F.regexp_replace(F.array_join(parts, "/"), r"/-/.*$", ""), "/")).otherwise(parts)
    data = (host == "huggingface.co") & F.coalesce(F.get(parts, 0).isin("datasets", "spaces"), F.lit(False))
    at = F.when(data, 1).otherwise(0)
    owner = F.get(parts, at)
    whole = F.when(host.startswith("gitlab."), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(F.slice(parts, at + 2, 1))
    path = F.regexp_replace(F.array_join(whole, "/"), r"\.git$", "")
    known = host.isin("github.com", "bitbucket.org", "huggingface.co") | host.startswith("gitlab.")
    lead = F.when(data, F.concat(host, F.lit("/"), F.get(parts, 0))).otherwise(host)
    repo = F.concat_ws("/", lead, F.lower(owner), F.when(path != "", F.lower(path)))
    kind = F.when(data & (F.get(parts, 0) == "datasets"), "data").otherwise("forge")
    return F.when(known & owner.isNotNull(), F.struct(repo.alias("repo"), host.alias("host"), kind.alias("kind"), owner.alias("owner"), F.element_at(F.split(path, "/"), -1).alias("name")))


def folded(text: Column) -> Column:
    """Lower case without accents, for comparing names: the marks that NFD parts from Latin letters go."""
    plain = {"a": "àáâãäåāăą", "c": "çćĉċč", "d": "ďđ", "e": "èéêëēĕėęě", "g": "ĝğġģ", "i": "ìíîïĩīĭį", "n": "ñńņň", "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţť", "u": "ùúûüũūŭůűų", "y": "ýÿ", "z": "źżž"}
    return F.translate(F.lower(text), "".join(plain.values()), "".join(k * len(v) for k, v in plain.items()))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD from parts; a month may be a number or an English name."""
    names = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    named = F.array_position(F.array(*[F.lit(n) for n in names]), F.substring(F.lower(F.trim(month)), 1, 3))
    m = F.coalesce(F.when(named > 0, named.cast("int")), F.try_to_number(F.trim(month), F.lit("99")).cast("int"))
    m = F.when(m.between(1, 12), F.lpad(m.cast("string"), 2, "0"))
    d = F.when(m.isNotNull() & day.between(1, 31), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.isNotNull(), F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), m, d))


def issue_references(text: Column) -> Column:
    """(number, closes) of each #n in a text, and whether a closing word stands before it."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?:\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?):?\s+)?(?<![\w&/])#\d+\b"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"#(\d+)", 1).cast("long").alias("number"), (~x.startswith("#")).alias("closes")))


def compatible(own: Column, other: Column) -> Column:
    """Whether work under license family ``own`` may build on ``other``; null where either is unknown."""
    rank = F.create_map(*[x for k, v in {"permissive": 0, "attribution": 0, "weak copyleft": 1, "copyleft": 2, "network copyleft": 3}.items() for x in (F.lit(k), F.lit(v))])
    return F.when(other == "non-commercial", False).otherwise(F.when(rank[other] <= 1, True).otherwise(rank[own] >= rank[other]))
