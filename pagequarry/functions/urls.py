"""URL functions on columns. All parts come from one regular expression; URLs with blanks, braces or underscores in the
host keep their parts, which Spark's own URL parser refuses.

Column functions expect absolute URLs as normalize_url() gives them; null and relative texts give null or the text itself,
as said with each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, that only resize an image, that only sign or address a video.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "dclid", "msclkid", "yclid", "mc_cid", "mc_eid"]
RESIZE = ["w", "width", "h", "height", "size", "s", "res", "resize", "r", "q", "quality", "auto", "fm", "f", "format", "crop", "fit", "gravity", "zoom", "dpr", "strip", "fl", "progressive", "enlarge", "blur", "pad", "extend", "max", "min", "scale", "rotate"]
VOLATILE = ["expires", "expire", "sig", "signature", "lsig", "sparams", "ip", "ipbits", "cp", "c", "eit", "ei", "oi", "pl", "gir", "ratebypass", "keepalive", "lmt", "mt", "mv", "ms", "source", "range", "rn", "rbuf", "sq", "efg", "_nc_ohc", "_nc_ht", "_nc_sid", "_nc_cat", "_nc_log", "_nc_rid", "oh", "oe", "se", "ccb", "ig_cache_key", "dl", "nc_ht", "token", "access_token"]
# Extensions and MIME types.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "bmp", "ico", "tif", "tiff"]
NON_HTML = IMAGE_EXTENSIONS + ["pdf", "zip", "rar", "7z", "gz", "tar", "mp3", "mp4", "webm", "ogg", "wav", "avi", "mov", "mkv", "mpg", "mpeg", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "exe", "msi", "dmg", "apk", "iso", "css", "js", "json", "xml", "txt", "csv", "woff", "woff2", "ttf", "otf", "eot", "swf"]
MIME_TO_EXT = {"image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/avif": "avif", "image/svg+xml": "svg", "image/bmp": "bmp", "image/x-icon": "ico", "image/tiff": "tiff"}
VIDEO_MIME_TO_EXT = {"video/mp4": "mp4", "video/webm": "webm", "video/ogg": "ogv", "video/quicktime": "mov", "video/x-matroska": "mkv", "video/x-msvideo": "avi", "video/x-flv": "flv", "video/mp2t": "ts", "application/x-mpegurl": "m3u8", "application/vnd.apple.mpegurl": "m3u8", "application/dash+xml": "mpd", "audio/mp4": "m4a", "audio/webm": "weba"}
EXT_TO_MIME = {"mp4": "video/mp4", "webm": "video/webm", "ogv": "video/ogg", "mov": "video/quicktime", "mkv": "video/x-matroska", "avi": "video/x-msvideo", "flv": "video/x-flv", "ts": "video/mp2t", "m3u8": "application/x-mpegurl", "mpd": "application/dash+xml", "m4a": "audio/mp4"}
EXT_TO_CONTAINER = {"m3u8": "hls", "mpd": "dash", "mp4": "mp4", "m4v": "mp4", "mov": "mp4", "3gp": "mp4", "webm": "webm", "mkv": "mkv", "ts": "ts", "m2ts": "ts", "mts": "ts", "flv": "flv", "avi": "avi", "ogv": "ogg"}
# Second levels under which country domains are registered.
SECOND_LEVELS = ["com", "co", "org", "net", "gov", "edu", "ac", "ne", "gouv", "govt", "gob", "gen", "info", "mil"]

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def is_http_url(c: Column) -> Column:
    return F.coalesce(c.rlike("^https?://[^/?#]"), F.lit(False))


def is_blob_url(c: Column) -> Column:
    return F.coalesce(c.startswith("blob:"), F.lit(False))


def is_data_url(c: Column) -> Column:
    return F.coalesce(c.startswith("data:"), F.lit(False))


def hostname_of(c: Column) -> Column:
    """Lower-case host without port; "" where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(c, _SCHEME + r"//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def origin_of(c: Column) -> Column:
    """scheme://host[:port]; "" where there is no host."""
    return F.coalesce(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1), F.lit(""))


def path_of(c: Column) -> Column:
    return F.regexp_extract(c, _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)


def query_of(c: Column) -> Column:
    """The query without its question mark; "" where there is none."""
    return F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)


def url_parts(c: Column) -> Column:
    return F.struct(origin_of(c).alias("origin"), hostname_of(c).alias("host"), path_of(c).alias("path"), query_of(c).alias("query"), F.regexp_extract(c, "#(.*)$", 1).alias("fragment"))


def without_fragment(c: Column) -> Column:
    return F.regexp_replace(c, "#.*$", "")


def _params(c: Column) -> Column:
    return F.filter(F.split(query_of(c), "&"), lambda p: p != "")


def _name(p: Column) -> Column:
    return F.lower(F.regexp_extract(p, "^([^=]*)", 1))


def _with_params(c: Column, params: Column) -> Column:
    base = F.regexp_extract(c, r"^([^?#]*)", 1)
    return F.when(F.size(params) > 0, F.concat(base, F.lit("?"), F.array_join(params, "&"))).otherwise(base)


def _strip(c: Column, names: list[str]) -> Column:
    return _with_params(c, F.filter(_params(c), lambda p: ~_name(p).isin(names)))


def canonical_url(c: Column) -> Column:
    """No fragment, no tracking parameters (names in any case), no bare question mark; blob: and data: URLs as they are."""
    return F.when(is_blob_url(c) | is_data_url(c), c).otherwise(_strip(c, TRACKING))


def image_variant_key(c: Column) -> Column:
    """/thumb_x becomes /x; the query goes only if every parameter is one that resizes."""
    whole = F.regexp_replace(without_fragment(c), r"(?i)^([^?]*/)thumb_([^/?]+)(\?|$)", "$1$2$3")
    params = _params(whole)
    return F.when((F.size(params) > 0) & F.forall(params, lambda p: _name(p).isin(RESIZE)), F.regexp_extract(whole, r"^([^?]*)", 1)).otherwise(whole)


def video_variant_key(c: Column, mode: str = "query") -> Column:
    """Origin, path and the parameters that matter, names in lower case and sorted, values decoded. mode="path": no query."""
    base = F.concat(origin_of(c), path_of(c))
    if mode == "path":
        return F.when(is_blob_url(c) | is_data_url(c), c).otherwise(base)
    kept = F.filter(_params(c), lambda p: ~_name(p).isin(TRACKING + VOLATILE))
    value = lambda p: F.coalesce(F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1)), F.regexp_extract(p, "=(.*)$", 1))
    keyed = F.transform(kept, lambda p, i: F.struct(_name(p).alias("k"), i.alias("i"), value(p).alias("v")))
    pairs = F.transform(F.array_sort(keyed), lambda s: F.concat(s["k"], F.lit("="), s["v"]))
    return F.when(is_blob_url(c) | is_data_url(c), c).otherwise(F.when(F.size(pairs) > 0, F.concat(base, F.lit("?"), F.array_join(pairs, "&"))).otherwise(base))


def expand_thumb_url(c: Column) -> Column:
    """The full picture's URL for .../thumb_x; null where there is no such prefix."""
    return F.nullif(F.regexp_replace(c, r"(?i)^([^?#]*/)thumb_([^/?#]+)([?#]|$)", "$1$2$3"), c)


def normalize_playback_url(c: Column) -> Column:
    """Playback URLs without range, rn, rbuf; others as they are."""
    playback = path_of(c).rlike("(?i)videoplayback") | hostname_of(c).rlike(r"googlevideo\.com$")
    return F.when(playback, _strip(c, ["range", "rn", "rbuf"])).otherwise(c)


def extension_from_url(c: Column) -> Column:
    """Lower-case extension of the path, 2 to 5 letters or digits; null without one and for blob: and data: URLs."""
    return F.when(~is_blob_url(c) & ~is_data_url(c), F.nullif(F.lower(F.regexp_extract(path_of(c), r"\.([A-Za-z0-9]{2,5})$", 1)), F.lit("")))


def _lookup(table: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def bare_mime(c: Column) -> Column:
    return F.trim(F.regexp_extract(F.lower(c), "^([^;]*)", 1))


def mime_to_ext(c: Column, kind: str = "image") -> Column:
    return _lookup(MIME_TO_EXT if kind == "image" else VIDEO_MIME_TO_EXT, bare_mime(c))


def ext_to_mime(c: Column) -> Column:
    return _lookup(EXT_TO_MIME, F.lower(c))


def container_from_ext(c: Column) -> Column:
    return F.coalesce(_lookup(EXT_TO_CONTAINER, F.lower(c)), F.lit("unknown"))


def is_html_page_url(c: Column) -> Column:
    return F.coalesce(~extension_from_url(c).isin(NON_HTML), F.lit(True))


def registrable_domain(c: Column) -> Column:
    """Last two labels of the host; three under a country's known second level; the whole host if it has fewer."""
    labels = F.split(hostname_of(c), r"\.")
    n = F.size(labels)
    country = F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.get(labels, n - 2).isin(SECOND_LEVELS)
    return F.when(n <= 2, hostname_of(c)).otherwise(F.array_join(F.slice(labels, F.when(country, -3).otherwise(-2), F.when(country, 3).otherwise(2)), "."))


def url_basename(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path_of(c), r"([^/]+)/*$", 1), F.lit("")), path_of(c))


def content_disposition_filename(c: Column) -> Column:
    """filename* first, then filename; percent-decoded where that is valid; null without one."""
    star = F.nullif(F.regexp_extract(c, r"filename\*=(?:UTF-8|utf-8)''([^;]+)", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(c, r'(?i)filename="?([^";]+)"?', 1), F.lit(""))
    name = F.coalesce(star, plain)
    return F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)


def param(c: Column, name: str) -> Column:
    """Raw value of a query parameter; null if absent."""
    return F.nullif(F.regexp_extract(query_of(c), f"(?:^|&){re.escape(name)}=([^&]*)", 1), F.lit(""))


_PORTS = {"http": "80", "https": "443", "ftp": "21"}
_ESCAPE = "!$&'()*+,;=:@/%~-._[]|^"


def _resolve(raw: str | None, base: str | None, keep_fragment: bool) -> str | None:
    if raw is None:
        return None
    text = raw.strip(" \t\r\n\f").replace("\t", "").replace("\n", "").replace("\r", "")
    try:
        joined = urlsplit(urljoin(base or "", text))
        scheme = joined.scheme.lower()
        if not scheme:
            return None
        if scheme not in ("http", "https", "ftp"):
            return text if re.match(r"^[A-Za-z][A-Za-z0-9+.\-]*:", text) else joined.geturl()
        host = (joined.hostname or "").encode("idna").decode() if not (joined.hostname or "").isascii() else (joined.hostname or "")
        if not host or re.search(r"[\s<>^|%#\\]", host):
            return None
        port = joined.port
        where = host if port is None or str(port) == _PORTS[scheme] else f"{host}:{port}"
        user = joined.netloc.rpartition("@")[0]
    except (ValueError, UnicodeError):
        return None
    parts: list[str] = []
    pieces = joined.path.replace("\\", "/").split("/")[1:] if joined.path else [""]
    for i, p in enumerate(pieces):
        if p in (".", "%2e", "%2E"):
            parts += [""] if i == len(pieces) - 1 else []
        elif p == "..":
            parts = parts[:-1] + ([""] if i == len(pieces) - 1 else [])
        else:
            parts.append(p)
    path = "/" + quote("/".join(parts), safe=_ESCAPE)
    query = "?" + quote(joined.query, safe=_ESCAPE + "?`{}\\") if joined.query else ""
    fragment = "#" + quote(joined.fragment, safe=_ESCAPE + "?{}\\") if keep_fragment and joined.fragment else ""
    return f"{scheme}://{user + '@' if user else ''}{where}{path}{query}{fragment}"


_PLAIN = r"[A-Za-z0-9_~.,!$&'()*+;=@-]"
_BASE_RX = rf"^(https?://[a-z0-9][a-z0-9.-]*(?::(?!80/|443/)[1-9][0-9]*)?)(/(?:{_PLAIN}*/)*){_PLAIN}*(?:\?[^#]*)?(?:#.*)?$"
_PATH_RX = rf"^/?{_PLAIN}+(?:/{_PLAIN}+)*/?(?:\?(?:{_PLAIN}|/|:)+)?$"
_DOTS_RX = r"(?:^|/)\.{1,2}(?:/|\?|$)"
_BASE, _PATH = re.compile(_BASE_RX), re.compile(_PATH_RX)
_HTTP = re.compile("https?://[^/?#]")
_WHOLE = re.compile(rf"https?://[a-z0-9][a-z0-9.-]*/(?:{_PLAIN}|/)*+(?:\?(?:{_PLAIN}|/|:)++)?")


def _plain_base(base: str | None) -> tuple[str, str] | None:
    """Origin and folder of a clean http(s) base; null for others and where the folder would be written otherwise."""
    m = _BASE.fullmatch(base or "")
    return m.groups() if m and "/." not in base and base.count("//") == 1 else None


def _plain(raw: str, base: tuple[str, str] | None) -> str | None:
    """What _resolve() gives for the common cases: a clean path against a clean base, or a clean whole URL. None for all else."""
    if "/." in raw or raw.startswith("."):
        return None
    if base and _PATH.fullmatch(raw):
        return base[0] + raw if raw[0] == "/" else base[0] + base[1] + raw
    return raw if _WHOLE.fullmatch(raw) else None


def normalize_url(raw: Column, base: Column | None = None, keep_fragment: bool = False) -> Column:
    """Absolute form of raw against base, cleaned up as browsers do (host in lower case, no default port, dot segments
    resolved, other characters percent-encoded); without its fragment unless kept; null where that fails."""

    @F.pandas_udf("string")
    def resolve(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raws, bases in pairs:
            known: dict[tuple, str | None] = {}
            out, last, parts = [], None, None
            for key in zip(raws, bases):
                raw, base = key
                if raw is None:
                    out.append(None)
                    continue
                if base is not last:
                    last, parts = base, _plain_base(base)
                url = _plain(raw, parts)
                if url is None:
                    if key not in known:
                        known[key] = _resolve(raw, base, keep_fragment)
                    url = known[key]
                out.append(url)
            yield pd.Series(out, dtype=object)

    return resolve(raw, base if base is not None else F.lit(None).cast("string"))


def resolve_plain(raw: Column, base: Column) -> Column:
    """normalize_url() in plain expressions for the common case: a path with or without a leading slash, without dot segments
    and characters that would be changed, against a clean http(s) base. Null for all else."""
    clean = raw.rlike(_PATH_RX) & ~raw.rlike(_DOTS_RX) & base.rlike(_BASE_RX) & ~path_of(base).rlike(_DOTS_RX)
    folder = F.when(raw.startswith("/"), F.lit("")).otherwise(F.regexp_extract(base, _BASE_RX, 2))
    return F.when(clean, F.concat(F.regexp_extract(base, _BASE_RX, 1), folder, raw))


def resolve(raw: Column, base: Column, keep_fragment: bool = False) -> Column:
    """normalize_url() where a base is always given. Rows pass through the helper in any case, and there the common case costs less
    than the same expressions here."""
    return normalize_url(raw, base, keep_fragment)


def resolve_each(raws: Column, base: Column) -> Column:
    """An array of texts resolved against base with their fragments, one row for all; http(s) URLs stay as they are."""

    @F.pandas_udf("array<string>")
    def resolve(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rows, bases in pairs:
            out = []
            for some, base in zip(rows, bases):
                parts = _plain_base(base)
                out.append(None if some is None else [r if r is None or _HTTP.match(r) else _plain(r, parts) or _resolve(r, base, True) for r in some])
            yield pd.Series(out, dtype=object)

    return resolve(raws, base)


def parse_srcset(c: Column) -> Column:
    """Array of (raw, width, height, density) from the items "URL [n(w|h|x)]" between commas; others are left out.

    raw still has to be resolved with normalize_url().
    """
    items = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\S+(\s+[0-9.]+[whx])?$"))

    def one(x: Column) -> Column:
        n, unit = F.regexp_extract(x, r"\s([0-9.]+)[whx]$", 1).try_cast("double"), F.regexp_extract(x, r"\s[0-9.]+([whx])$", 1)
        whole = F.floor(n + 0.5).cast("int")
        return F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("raw"), F.when(unit == "w", whole).alias("width"), F.when(unit == "h", whole).alias("height"), F.when(unit == "x", n).alias("density"))

    return F.transform(items, one)
