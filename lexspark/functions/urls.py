"""URL parsing, repair, validity, priority and routing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts that make a URL unwanted wherever they stand.
BANNED = (
    *"0123456789", " ", "?", "#", "*", "&", "$", "@", ".pdf", ".md", ".exe", ".word", ".mp4", ".ppt", "http://", ".ru", ".cn", "tw",
    "pornhub", "porn", "utsa.edu", "uth.edu", "tufts.edu", "github", "gitlab", "commit", "adactio.com", "usnews", "vk.com", "Vk.com",
    "archieve", "58.com", "vndb.org", "pixy.org", "colorgg.com", "/v/", "/person/", "/pages/", "/node",
)

MIME = {
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "application/javascript", "json": "application/json", "txt": "text/plain",
    "xml": "application/xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml",
    "ico": "image/x-icon", "webp": "image/webp", "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip",
    "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4", "webm": "video/webm", "woff": "font/woff", "woff2": "font/woff2",
}


def _escaped(s: str) -> str:
    return "".join(c if c.isalnum() or c in "/@ #&" else "\\" + c for c in s)


BANNED_RE = "^\n|" + "|".join(_escaped(b) for b in BANNED)


def valid(url: Column) -> Column:
    """Whether a URL may be crawled: not empty, nothing banned in it, and a dot."""
    return F.coalesce((url != "") & ~url.rlike(BANNED_RE) & url.contains("."), F.lit(False))


def with_scheme(url: Column) -> Column:
    return F.when(url.contains("https://"), url).otherwise(F.concat(F.lit("https://"), url))


_PARTS = r"^(?:([a-z]+)://)?([^/:]*)(?::([0-9]*))?/?(.*)$"


def parse(url: Column) -> Column:
    """Struct of service, host, port and path (without its leading slash); a URL that
    doesn't begin with http counts as https."""
    full = F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.struct(*[F.regexp_extract(full, _PARTS, k + 1).alias(n) for k, n in enumerate(("service", "host", "port", "path"))])


def fix_relative(base: Column, rel: Column) -> Column:
    """An absolute URL for a link found on the page ``base``. Links that begin with
    neither a slash, a fragment nor a parent step stay as they are."""
    p = parse(base)
    root = F.concat(p["service"], F.lit("://"), p["host"], F.lit("/"))
    ups = F.length(F.regexp_extract(rel, r"^((?:\.\./)*)", 1)) / 3
    parts = F.split(p["path"], "/")
    kept = F.greatest(F.size(parts) - 1 - ups.cast("int"), F.lit(0))
    folder = F.array_join(F.slice(parts, F.lit(1), kept), "/")
    folder = F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(rel.startswith("//"), F.concat(F.lit("https:"), rel))
        .when(rel.startswith("/"), F.concat(root, F.substr(rel, F.lit(2))))
        .when(rel.startswith("#"), F.concat(base, rel))
        .when(rel.startswith("../"), F.concat(root, folder, F.regexp_replace(rel, r"^(?:\.\./)+", "")))
        .otherwise(rel)
    )


def priority(url: Column, by_host: bool = False) -> Column:
    """Crawl priority: by top-level domain, less for length. ``by_host`` also takes the
    host's length and dashes into account; without it the host counts two characters."""
    base = (
        F.when(url.contains(".edu") | url.contains(".gov") | url.contains(".com") | url.contains(".org"), 850)
        .when(url.contains(".net"), 750)
        .when(url.contains(".biz"), 700)
        .otherwise(650)
    )
    host = F.regexp_extract(url, "://([^/]*)", 1)
    penalty = 2 * F.length(host) + F.when(host.rlike("[-_]"), 100).otherwise(0) if by_host else F.lit(4)
    return F.when(~url.contains("://"), 10).otherwise(base - penalty - F.length(url)).cast("int")


def simplify(url: Column) -> Column:
    """Without the first 8 characters (the scheme) and a leading ``www.``."""
    return F.regexp_replace(F.substr(url, F.lit(9)), r"^www\.", "")


def domain_name(url: Column) -> Column:
    """What stands between the first two dots, or before the only one."""
    parts = F.split(url, r"\.")
    return F.when(F.size(parts) > 2, parts[1]).otherwise(parts[0])


def domain_suffix(url: Column) -> Column:
    """The four characters before the first slash, or the last four."""
    return F.right(F.substring_index(url, "/", 1), F.lit(4))


def is_home_page(url: Column) -> Column:
    """At most one dot and no slash."""
    return url.rlike(r"^[^/.]*(\.[^/.]*)?$")


def machine(url: Column, machines: int) -> Column:
    """The machine that owns a URL: the first 8 bytes of its MD5, little-endian, modulo."""
    h = F.md5(url.cast("binary"))
    flipped = F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)])
    return F.pmod(F.conv(flipped, 16, 10).cast("decimal(20,0)"), F.lit(machines).cast("decimal(20,0)")).cast("int")


def percent_decode(text: Column) -> Column:
    """Percent escapes decoded as UTF-8 (bytes that aren't UTF-8 as the replacement
    character), bad escapes left as they are, plus signs kept."""
    safe = F.regexp_replace(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.try_url_decode(safe)


def doc_key(url: Column) -> Column:
    """A file name for a URL: its parts joined by @, slashes and tildes as ampersands."""
    p = parse(url)
    return F.translate(F.concat_ws("@", p["service"], p["host"], p["port"], p["path"]), "/~", "&&")


def mime_type(path: Column) -> Column:
    """By the extension, else application/octet-stream."""
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("application/octet-stream"))


def encode_results(seq: Column, rows: Column) -> Column:
    """A result message: sequence number, row count, then title, abstract, url and score
    of each row, joined by @ (no escaping)."""
    fields = F.flatten(F.transform(rows, lambda r: F.array(r["title"], r["abstract"], r["url"], r["score"].cast("string"))))
    return F.concat_ws("@", seq.cast("string"), F.size(rows).cast("string"), fields)


def decode_results(message: Column) -> Column:
    """Array of structs (title, abstract, url, score) of a result message, which is split
    once, not for each field."""

    def rows(parts: Column) -> Column:
        n = F.get(parts, F.lit(1)).cast("int")
        at = lambda k, i: F.get(parts, i + 4 * k)
        row = lambda k: F.struct(at(k, 2).alias("title"), at(k, 3).alias("abstract"), at(k, 4).alias("url"), at(k, 5).cast("long").alias("score"))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), row)).otherwise(F.expr("array()").cast("array<struct<title:string,abstract:string,url:string,score:bigint>>"))

    return F.get(F.transform(F.array(F.split(message, "@")), rows), F.lit(0))
