"""Media metadata from recorded responses: headers, magic bytes, boxes, sanity rules."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions import urls

HEAD_BYTES, PRINT_BYTES = 65536, 4096
SNIFFED = "width int, height int, mime string, kind string"
BOXES = "width int, height int, duration double, codecs string"
# Brands of the file-type box and their MIME types.
BRANDS = {"qt  ": "video/quicktime", "M4V ": "video/x-m4v", "M4VP": "video/x-m4v", "3gp4": "video/3gpp", "3gp5": "video/3gpp", "3gp6": "video/3gpp", "3g2a": "video/3gpp2", "3g2b": "video/3gpp2", "M4A ": "audio/mp4", "M4B ": "audio/mp4"}
CONTAINERS = {"video/mp4": "mp4", "video/webm": "webm", "video/ogg": "ogg", "video/quicktime": "mp4", "video/x-matroska": "mkv", "video/x-msvideo": "avi", "video/x-flv": "flv", "video/mp2t": "ts", "audio/mp4": "mp4", "audio/webm": "webm"}


def resolve_headers(cands: DataFrame, responses: DataFrame, url: str = "image_url") -> DataFrame:
    """Adds mime, size, disposition, final_url, http_status: the HEAD response first, gaps filled from GET; the size is
    the total of content-range, else content-length. Responses are cut down to these fields before the joins."""
    h = lambda n: F.col("headers")[n]
    total = F.regexp_extract(h("content-range"), r"/([0-9]+)$", 1).try_cast("long")
    fields = {"mime": urls.bare_mime(h("content-type")), "size": F.coalesce(total, h("content-length").try_cast("long")), "disposition": h("content-disposition"), "final": F.col("final_url"), "http_status": F.col("status")}

    def one(method: str) -> DataFrame:
        picked = responses.where(F.col("method") == method).select(F.col("url").alias("_url"), F.struct(*[v.alias(k) for k, v in fields.items()]).alias(method), "seq")
        return picked.groupBy("_url").agg(F.min_by(method, "seq").alias(method))

    out = cands
    for method in ("HEAD", "GET"):
        r = one(method)
        out = out.join(r, out[url] == r["_url"], "left").drop("_url")
    names = {"mime": "header_mime", "size": "header_size", "disposition": "disposition", "final": "final_url", "http_status": "http_status"}
    return out.select(*cands.columns, *[F.coalesce(F.col(f"HEAD.{k}"), F.col(f"GET.{k}")).alias(v) for k, v in names.items()])


def _u(b: bytes, at: int, n: int, order: str = "big") -> int | None:
    return int.from_bytes(b[at : at + n], order) if at + n <= len(b) else None


def _jpeg(b: bytes) -> tuple:
    at = 2
    while at + 9 <= len(b):
        if b[at] != 0xFF:
            at += 1
            continue
        marker = b[at + 1]
        if marker == 0xD9:
            break
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            if w and h:
                return w, h, "image/jpeg", "raster"
        size = _u(b, at + 2, 2) or 0
        if size < 2:
            break
        at += 2 + size
    return None, None, "image/jpeg", "raster"


def _webp(b: bytes) -> tuple:
    at = 12
    while at + 8 <= len(b):
        kind, size = b[at : at + 4], int.from_bytes(b[at + 4 : at + 8], "little")
        if kind == b"VP8 " and at + 18 <= len(b):
            return _u(b, at + 14, 2, "little") & 0x3FFF, _u(b, at + 16, 2, "little") & 0x3FFF, "image/webp", "raster"
        if kind == b"VP8L" and at + 13 <= len(b):
            v = _u(b, at + 9, 4, "little")
            return (v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1, "image/webp", "raster"
        if kind == b"VP8X" and at + 18 <= len(b):
            return _u(b, at + 12, 3, "little") + 1, _u(b, at + 15, 3, "little") + 1, "image/webp", "raster"
        at += 8 + size + size % 2
    return None, None, "image/webp", "raster"


def _sniff(b: bytes | None, hint: str | None) -> tuple:
    """width, height, mime, kind (raster, svg, unknown). The sizes of BMP and WebP are read as these formats store them."""
    b = b or b""
    head = b[:4096].decode("latin-1")
    svg = bool(re.match(r"\s*<svg[\s>]", head[:1024], re.I) or re.match(r"\s*<\?xml[\s\S]*<svg", head[:1024], re.I) or re.search(r"<(svg|image)[\s>]", head[:1024], re.I))
    if len(b) < 9:
        return None, None, None, "svg" if b and svg else "unknown"
    if b[:4] == b"\x89PNG":
        return _u(b, 16, 4), _u(b, 20, 4), "image/png", "raster"
    if b[:4] == b"GIF8":
        return _u(b, 6, 2, "little"), _u(b, 8, 2, "little"), "image/gif", "raster"
    if b[:2] == b"BM":
        h = _u(b, 22, 4, "little")
        return _u(b, 18, 4, "little"), None if h is None else min(h, (1 << 32) - h), "image/bmp", "raster"
    if b[:3] == b"\xff\xd8\xff":
        return _jpeg(b)
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        return _webp(b)
    if b[4:8] == b"ftyp" and b[8:12] in (b"avif", b"avis"):
        at = b.find(b"ispe")
        w, h = (_u(b, at + 8, 4), _u(b, at + 12, 4)) if at >= 0 else (None, None)
        return (w, h, "image/avif", "raster") if w and h else (None, None, "image/avif", "raster")
    if b[:4] == b"\0\0\1\0" and (b[4] or b[5]):
        return b[6] or 256, b[7] or 256, "image/x-icon", "raster"
    if svg:
        w, h = (re.search(rf"<svg[^>]*\b{n}=[\"']([0-9.]+)(?:px)?[\"']", head) for n in ("width", "height"))
        return (int(float(w[1]) + 0.5) if w else None), (int(float(h[1]) + 0.5) if h else None), "image/svg+xml", "svg"
    if hint and hint.startswith("image/"):
        return None, None, hint, "svg" if "svg" in hint else "raster"
    return None, None, None, "unknown"


def _struct_udf(f: Callable, schema: str) -> Callable:
    names = [x.split(" ")[0] for x in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([f(*x) for x in zip(a, b)], columns=names, dtype=object)
        return out.where(out.notna(), None)

    return run


def sniff_image(body: Column, mime: Column) -> Column:
    return _struct_udf(_sniff, SNIFFED)(F.substring(body, 1, HEAD_BYTES), mime)


def _walk(b: bytes, at: int, end: int):
    while at + 8 <= end:
        size, kind = int.from_bytes(b[at : at + 4], "big"), b[at + 4 : at + 8]
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = int.from_bytes(b[at + 8 : at + 16], "big"), 16
        size = size or end - at
        if size < head:
            return
        yield kind, at + head, min(at + size, end)
        at += size


def _boxes(b: bytes | None, container: str | None) -> tuple:
    """width, height, duration (seconds), codecs of an MP4 head: the movie box's length, the largest track, sample entries."""
    width = height = duration = None
    codecs: list[str] = []
    if not b or container not in (None, "mp4"):
        return None, None, None, None
    stack = [(0, len(b))]
    while stack:
        for kind, s, e in _walk(b, *stack.pop()):
            if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
                stack.append((s, e))
            elif kind == b"mvhd" and e - s >= 20:
                scale, ticks = (_u(b, s + 20, 4), _u(b, s + 24, 8)) if b[s] == 1 else (_u(b, s + 12, 4), _u(b, s + 16, 4))
                duration = ticks / scale if scale and ticks else duration
            elif kind == b"tkhd" and e - s >= 8:
                w, h = _u(b, e - 8, 4), _u(b, e - 4, 4)
                if w and h and (w >> 16) * (h >> 16) > (width or 0) * (height or 0):
                    width, height = w >> 16, h >> 16
            elif kind == b"stsd" and e - s >= 16:
                codecs.append(b[s + 12 : s + 16].decode("latin-1"))
    return width, height, duration, ",".join(sorted(set(codecs))) or None


def parse_media_boxes(body: Column, container: Column) -> Column:
    return _struct_udf(_boxes, BOXES)(F.substring(body, 1, HEAD_BYTES), container)


def fingerprint(body: Column, kind: Column | None = None, mime: Column | None = None, least: int = 0) -> Column:
    """SHA-1 of the first 4096 bytes; for images only with a known kind and an image type; null for fewer than least bytes."""
    known = F.length(body) >= least
    if kind is not None:
        known = known & (kind != "unknown") & mime.startswith("image/")
    return F.when(known, F.sha1(F.substring(body, 1, PRINT_BYTES)))


def image_metadata(cands: DataFrame, responses: DataFrame) -> DataFrame:
    """Final metadata of image candidates: type from the bytes, else from the header; extension from the header's type, else
    from the bytes'; sizes from the bytes, else known ones; fingerprint; status ready unless downloaded or failed."""
    got = responses.where("method = 'GET' and body is not null").select("url", "seq", sniff_image(F.col("body"), urls.bare_mime(F.col("headers")["content-type"])).alias("s"), F.sha1(F.substring("body", 1, PRINT_BYTES)).alias("sha"))
    got = got.groupBy(F.col("url").alias("_url")).agg(F.min_by(F.struct("s", "sha"), "seq").alias("g"))
    df = resolve_headers(cands, responses)
    df = df.join(got, df["image_url"] == got["_url"], "left")
    mime = F.coalesce("g.s.mime", "header_mime")
    w, h = F.coalesce("g.s.width", "width"), F.coalesce("g.s.height", "height")
    ext = F.coalesce(urls.mime_to_ext(F.col("header_mime")), urls.mime_to_ext(F.col("g.s.mime")), F.col("extension"))
    aspect = F.try_divide(F.nullif(w, F.lit(0)).cast("double"), F.nullif(h, F.lit(0)).cast("double"))
    print_ = F.when((F.col("g.s.kind") != "unknown") & mime.startswith("image/"), F.col("g.sha"))
    new = {"mime_type": mime, "extension": ext, "width": w, "height": h, "file_size": F.coalesce("header_size", "file_size") if "file_size" in cands.columns else F.col("header_size"), "aspect_ratio": aspect, "fingerprint": print_, "status": F.when(F.col("status").isin("downloaded", "failed"), F.col("status")).otherwise("ready")}
    keep = [c for c in cands.columns if c not in new]
    return df.select(*keep, *[v.alias(k) for k, v in new.items()])


def _from_hint(url: Column, mime: Column) -> Column:
    m, ext = urls.bare_mime(mime), urls.extension_from_url(url)
    by_ext = urls.ext_to_mime(ext)
    use = F.when(m.rlike("^(video|audio)/"), m).otherwise(by_ext)
    container = F.when(use.rlike("mpegurl") | (use.isNotNull() & (ext == "m3u8")), "hls").when(use.rlike(r"dash\+xml") | (use.isNotNull() & (ext == "mpd")), "dash").otherwise(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in CONTAINERS.items() for x in p]), use), F.lit("unknown")))
    manifest = container.isin("hls", "dash")
    return F.struct(container.alias("container"), use.alias("mime"), manifest.alias("is_manifest"), F.lit(False).alias("is_encrypted"), F.lit(False).alias("is_drm"), F.when(use.isNull(), 0.0).when(manifest, 0.7).otherwise(0.5).alias("confidence"))


def detect_format(body: Column, url: Column, mime: Column) -> Column:
    """container, mime, is_manifest, is_encrypted, is_drm, confidence from magic bytes or text, then type, then extension."""
    hx = F.hex(F.substring(body, 1, 256))
    text = F.trim(F.regexp_replace(F.decode(F.substring(body, 1, 256), "ISO-8859-1"), r"^\s+|\s+$", ""))

    def result(container: Column | str, mime_: Column | str, confidence: float, manifest: bool = False, encrypted: Column | bool = False, drm: Column | bool = False) -> Column:
        wrap = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(wrap(container).alias("container"), wrap(mime_).alias("mime"), F.lit(manifest).alias("is_manifest"), wrap(encrypted).alias("is_encrypted"), wrap(drm).alias("is_drm"), F.lit(confidence).alias("confidence"))

    brand = F.decode(F.substring(body, 9, 4), "ISO-8859-1")
    method = F.regexp_extract(text, r"(?i)EXT-X-KEY:.*METHOD=([^,\s]*)", 1)
    matroska = F.contains(hx, F.lit("6D6174726F736B61"))
    is_ts = F.startswith(hx, F.lit("47")) & ((F.length(body) < 189) | (F.hex(F.substring(body, 189, 1)) == "47"))
    found = (
        F.when(text.rlike(r"(?i)^#EXTM3U|^#EXT-X-"), result("hls", "application/x-mpegurl", 0.99, True, (method != "") & (F.upper(method) != "NONE"), text.rlike("(?i)SAMPLE-AES")))
        .when(text.rlike(r"(?i)^<\?xml") & text.rlike(r"(?i)<MPD[\s>]"), result("dash", "application/dash+xml", 0.99, True, False, text.rlike(r"(?is)ContentProtection.*schemeIdUri")))
        .when((F.length(body) >= 12) & (F.substring(hx, 9, 8) == "66747970"), result("mp4", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in BRANDS.items() for x in p]), brand), F.lit("video/mp4")), 0.98))
        .when(F.startswith(hx, F.lit("1A45DFA3")), result(F.when(matroska, "mkv").otherwise("webm"), F.when(matroska, "video/x-matroska").otherwise("video/webm"), 0.97))
        .when(F.startswith(hx, F.lit("52494646")) & (F.substring(hx, 17, 8) == "41564920"), result("avi", "video/x-msvideo", 0.98))
        .when(F.startswith(hx, F.lit("464C56")), result("flv", "video/x-flv", 0.99))
        .when(is_ts, result("ts", "video/mp2t", 0.85))
        .when(F.startswith(hx, F.lit("4F676753")), result("ogg", "video/ogg", 0.95))
        .when((F.length(body) < 64) & text.rlike(r"(?i)^https?://") & text.rlike(r"(?i)key\.bin|key$"), result("unknown", "application/octet-stream", 0.5, False, True))
        .otherwise(_from_hint(url, mime))
    )
    return F.when(F.coalesce(F.length(body), F.lit(0)) == 0, _from_hint(url, mime)).otherwise(found)


def query_param_meta(url: Column, size: Column, mime: Column) -> Column:
    """size, mime, duration with the URL's clen, mime and dur where the headers tell nothing useful."""
    clen, dur = urls.param(url, "clen").try_cast("long"), urls.param(url, "dur").try_cast("double")
    told = F.try_url_decode(urls.param(url, "mime"))
    useless = F.coalesce(mime, F.lit("")).isin("", "application/octet-stream", "text/plain")
    return F.struct(F.when(size.isNull() | (size < 16384), F.coalesce(clen, size)).otherwise(size).alias("size"), F.when(useless, F.coalesce(told, mime)).otherwise(mime).alias("mime"), sane_duration(dur).alias("duration"))


def sane_duration(c: Column) -> Column:
    return F.when((c > 0) & (c <= 48 * 3600), c)


def bitrate_kbps(size: Column, duration: Column) -> Column:
    return F.floor(F.try_divide(size * 8.0, F.when(duration > 0, duration) * 1000) + 0.5).cast("long")


def looks_like_error_payload(body: Column) -> Column:
    t = F.lower(F.regexp_replace(F.decode(F.substring(body, 1, 512), "ISO-8859-1"), r"^\s+", ""))
    return t.rlike(r'^(<!doctype|<html)|^\{\s*"(error|responsecontext|playabilitystatus|errormessage)"') | (t.startswith("{") & F.left(t, F.lit(200)).rlike(r'"error"\s*:'))


def classify_suspicious(mime: Column, size: Column) -> Column:
    return F.when(F.lower(mime).rlike("text/|json|xml"), "type").when((size > 0) & (size < 16384), "small")


def classify_http_status(c: Column) -> Column:
    return F.when(c.isin(401, 403, 404), "permanent").when((c == 429) | (c >= 500), "retryable").otherwise("ok")


def video_status_after_meta(df: DataFrame) -> DataFrame:
    """status failed for dead stubs, else ready; hotlink where the server refused."""
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    dead = (F.col("container") == "unknown") & (F.coalesce("file_size", F.lit(0)) == 0) & ~flag("is_manifest") & ~flag("is_blob") & ~flag("is_live")
    return df.withColumns({"status": F.when(dead, "failed").otherwise("ready"), "hotlink": F.coalesce(F.col("http_status").isin(401, 403), F.lit(False))})


def derive_title(page_title: Column, width: Column, height: Column, duration: Column, live: Column) -> Column:
    """Page title with resolution, and "live" or "long" (an hour or more)."""
    size = F.when((width > 0) & (height > 0), F.concat(height.cast("string"), F.lit("p")))
    kind = F.when(F.coalesce(live, F.lit(False)), "live").when(duration >= 3600, "long")
    return F.concat_ws(" · ", F.nullif(F.trim(page_title), F.lit("")), size, kind)
