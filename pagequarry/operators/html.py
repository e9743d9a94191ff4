"""From pages to elements, and from elements to image and video candidates.

html_elements() is the one Python helper: the standard library's tokenizer over Arrow batches, one row per element that some
detector looks at. The detectors are DataFrame operations on those rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions import urls

# Attributes that hold a picture until it is loaded; metadata that name one, in the detectors' order.
LAZY = ["data-src", "data-lazy-src", "data-lazy", "data-original", "data-original-src", "data-url", "data-image", "data-img", "data-photo-src", "data-echo", "data-src-large"]
META = [("property", "og:image"), ("property", "og:image:secure_url"), ("property", "og:image:url"), ("name", "twitter:image"), ("name", "twitter:image:src"), ("itemprop", "image")]
TAGS = {"img", "source", "meta", "link", "a", "input", "video", "iframe", "picture", "script"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MAX_BODY, MAX_SCRIPT = 8 << 20, 4 << 20
_SCHEMA = "page_id bigint, url string, el_no int, tag string, parent string, parent_no int, attrs map<string,string>, text string"


class _Elements(HTMLParser):
    def __init__(self, most_script: int | None, wanted: Callable[[str, str], bool]) -> None:
        super().__init__(convert_charrefs=True)
        self.most_script = most_script
        self.wanted = wanted
        self.rows: list[list] = []
        self.open: list[tuple[str, int]] = []
        self.n = 0
        self.script: list | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        self.script = None if tag == "script" else self.script
        if self.wanted(tag, found.get("style", "")):
            parent = self.open[-1] if self.open else ("", -1)
            self.rows.append([self.n, tag, parent[0], parent[1], found, None])
            self.script = self.rows[-1] if tag == "script" else self.script
        if tag not in VOID:
            self.open.append((tag, self.n))
        self.n += 1

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self.script = None
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script[5] = (self.script[5] or "") + data[: self.most_script]


_WS = r"[ \t\n\r\f]"
_ATTRIBUTE = rf"{_WS}++([A-Za-z_:@][-A-Za-z0-9_:.@]*+)(?:=(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'=<>`]++)))?"
_BARE_ATTRIBUTE = re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE)
#: A tag, a comment or a document type in its regular form; the empty last branch stands for anything else after "<".
_TOKEN = re.compile(rf"<(?:([A-Za-z][-A-Za-z0-9:_]*+)((?:{_BARE_ATTRIBUTE})*+){_WS}*+(/?)>|/([A-Za-z][-A-Za-z0-9:_]*+){_WS}*+>|!--[^-]*+(?:-[^-][^-]*+)*+-->|!(?i:doctype)[^>]*+>|())")
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_RAW_END = {tag: re.compile(rf"(?i)</\s*{tag}\s*>") for tag in ("script", "style")}


def _regular_elements(html: str, wanted: Callable[[str, str], bool]) -> list[list] | None:
    """The rows of _Elements for regular HTML, in one expression's pass over its tags; None where something else is met, for
    which the tokenizer's rules are needed."""
    rows, opened, n, at, token = [], [], 0, 0, _TOKEN.search
    while (m := token(html, at)) is not None:
        at = m.end()
        tag, attrs, closed, end, other = m.groups()
        if tag is not None:
            tag = tag.lower()
            row = None
            style = "background" in attrs
            if style or wanted(tag, ""):
                found: dict[str, str] = {}
                for k, a, b, c in _ATTRIBUTES.findall(attrs):
                    v = a or b or c
                    found.setdefault(k.lower(), unescape(v) if "&" in v else v)
                if not style or wanted(tag, found.get("style", "")):
                    parent = opened[-1] if opened else ("", -1)
                    row = [n, tag, parent[0], parent[1], found, None]
                    rows.append(row)
            if tag not in VOID:
                opened.append((tag, n))
            n += 1
            if closed:
                end = tag
            elif tag in _RAW_END:
                stop = _RAW_END[tag].search(html, at)
                if stop is None:
                    return None
                if row is not None and tag == "script":
                    row[5] = html[at : stop.start()] or None
                at, end = stop.end(), tag
        elif other is not None:
            return None
        if end is not None:
            end = end.lower()
            if opened and opened[-1][0] == end:
                opened.pop()
            elif any(t == end for t, _ in opened):
                while opened.pop()[0] != end:
                    pass
    return rows


def elements_of(html: str, wanted: Callable[[str, str], bool], most_script: int | None = None) -> list[list]:
    """The elements of a page that are asked for, by the short way where the page allows it."""
    rows = _regular_elements(html, wanted) if most_script is None else None
    if rows is None:
        parser = _Elements(most_script, wanted)
        parser.feed(html)
        rows = parser.rows
    return rows


def html_elements(pages: DataFrame, most: int | None = None, most_script: int | None = None, tags: set[str] | None = None) -> DataFrame:
    """page_id, url, el_no, tag, parent, parent_no, attrs, text (of scripts) from pages (page_id, url, html).

    The first of an attribute given twice counts; null html has no elements. most, most_script: characters of a body and of each
    piece of a script that are read (MAX_BODY, MAX_SCRIPT for the usual caps; None: all). tags: the elements that are asked for,
    by name, "style" for all with a background (None: those of all detectors); numbers and parents don't depend on it.
    """
    names_wanted, styled = TAGS if tags is None else frozenset(tags), tags is None or "style" in tags

    def wanted(tag: str, style: str) -> bool:
        return tag in names_wanted or (styled and "background" in style)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in _SCHEMA.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows, page = [], []
                for i, html in enumerate(part.column(2).to_pylist()):
                    found = elements_of((html or "")[:most], wanted, most_script)
                    rows += found
                    page += [i] * len(found)
                if rows:
                    el_no, tag, parent, parent_no, attrs, text = zip(*rows)
                    ends = [0]
                    for x in attrs:
                        ends.append(ends[-1] + len(x))
                    keys, values = (pa.array([y for x in attrs for y in of(x)], pa.string()) for of in (dict.keys, dict.values))
                    told = [pa.array(el_no, pa.int32()), pa.array(tag, pa.string()), pa.array(parent, pa.string()), pa.array(parent_no, pa.int32()), pa.MapArray.from_arrays(pa.array(ends, pa.int32()), keys, values), pa.array(text, pa.string())]
                    of_page = pa.array(page, pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(of_page), part.column(1).take(of_page).cast(pa.string()), *told], names=names)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, _SCHEMA)


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


_ITEM = "struct<detector_no:int,el_no:int,item_no:int,source_type:string,raw:string,width:int,height:int>"


def _hits(when: Column, detector: int, source: str, raw: Column, item_from: int = 0, el_from: int = 0) -> Column:
    """Of one element: an array of what a detector takes from it (raw: array of raw, width, height), with its place."""

    def one(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(detector).alias("detector_no"), (F.col("el_no") + el_from).alias("el_no"), (i + item_from).alias("item_no"), F.lit(source).alias("source_type"), x["raw"].alias("raw"), x["width"].alias("width"), x["height"].alias("height")
        )

    return F.when(when, F.transform(raw, one)).otherwise(F.array().cast(f"array<{_ITEM}>"))


def _exploded(elements: DataFrame, *hits: Column) -> DataFrame:
    """The hits of all elements in one pass over them."""
    flat = elements.select("page_id", "url", _attr("alt").alias("alt"), _attr("title").alias("title"), F.explode(F.concat(*hits)).alias("x"))
    return flat.select("page_id", "url", "x.*", "alt", "title")


def _tag(name: str) -> Column:
    return F.col("tag") == name


def _single(c: Column) -> Column:
    null = F.lit(None).cast("int")
    return F.array(F.struct(c.alias("raw"), null.alias("width"), null.alias("height"), F.lit(None).cast("double").alias("density")))


def _given(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _img() -> list[Column]:
    srcset = F.coalesce(F.nullif(_attr("srcset"), F.lit("")), _attr("data-srcset"))
    return [_hits(_tag("img"), 1, "srcset", urls.parse_srcset(srcset)), _hits(_tag("img") & _given(_attr("src")), 1, "img", _single(_attr("src")), 10_000)]


def _lazy() -> list[Column]:
    own = [F.when(F.trim(F.coalesce(_attr(a), F.lit(""))) != "", F.trim(_attr(a))) for a in LAZY]
    values = F.array_compact(F.array(*own))
    many = lambda v: F.when(v.rlike(r"\s") & ~v.startswith("data:"), urls.parse_srcset(v)).otherwise(_single(v))
    return [_hits(_tag("img"), 1, "lazy", F.flatten(F.transform(values, many)), 20_000)]


def _picture() -> list[Column]:
    some = _tag("source") & _attr("srcset").isNotNull()
    return [_hits(some & (F.col("parent") == "picture"), 2, "picture", urls.parse_srcset(_attr("srcset"))), _hits(some, 3, "picture", urls.parse_srcset(_attr("srcset")))]


def _meta() -> list[Column]:
    content = _tag("meta") & _given(_attr("content"))
    return [_hits(content & F.coalesce(_attr(k) == v, F.lit(False)), 4, "meta", _single(_attr("content")), el_from=i * 10_000_000) for i, (k, v) in enumerate(META)]


def _link_rel() -> list[Column]:
    rel = F.array_contains(F.split(F.coalesce(_attr("rel"), F.lit("")), r"\s+"), "image_src")
    return [_hits(_tag("link") & rel & _given(_attr("href")), 5, "link", _single(_attr("href")))]


def _anchor() -> list[Column]:
    return [_hits(_tag("a") & _given(_attr("href")), 6, "link", _single(_attr("href")))]


def _input() -> list[Column]:
    return [_hits(_tag("input") & F.coalesce(F.lower(_attr("type")) == "image", F.lit(False)) & _given(_attr("src")), 7, "other", _single(_attr("src")))]


def _background_urls() -> Column:
    found = F.regexp_extract_all(_attr("style"), F.lit(r"url\(\s*(?:'([^']*)'|\"([^\"]*)\"|([^'\")]*?))\s*\)"), F.lit(0))
    bare = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"^url\(\s*['\"]?", ""), r"['\"]?\s*\)$", ""))
    return F.filter(bare, lambda x: (x != "") & ~x.startswith("data:") & ~F.contains(x, F.lit("var(")))


def _background() -> list[Column]:
    null = F.lit(None).cast("int")
    items = F.transform(_background_urls(), lambda x: F.struct(x.alias("raw"), null.alias("width"), null.alias("height"), F.lit(None).cast("double").alias("density")))
    return [_hits(F.contains(F.coalesce(_attr("style"), F.lit("")), F.lit("background")), 8, "background", items)]


def detect_img(elements: DataFrame) -> DataFrame:
    return _exploded(elements, *_img())


def detect_lazy(elements: DataFrame) -> DataFrame:
    return _exploded(elements, *_lazy())


def detect_picture(elements: DataFrame) -> DataFrame:
    return _exploded(elements, *_picture())


def detect_meta(elements: DataFrame) -> DataFrame:
    return _exploded(elements, *_meta())


def detect_link_rel(elements: DataFrame) -> DataFrame:
    return _exploded(elements, *_link_rel())


def detect_anchor_images(elements: DataFrame) -> DataFrame:
    return _exploded(elements, *_anchor())


def detect_input_images(elements: DataFrame) -> DataFrame:
    return _exploded(elements, *_input())


def detect_background(elements: DataFrame) -> DataFrame:
    return _exploded(elements, *_background())


def detect_media_paths(pages: DataFrame) -> DataFrame:
    paths = F.regexp_extract_all("html", F.lit(r"(?i)(/media/r/[^\"'\s<>]+?\.(?:jpe?g|png|gif|webp|avif))"), F.lit(1))
    null = F.lit(None)
    return pages.select("page_id", "url", F.posexplode(paths).alias("item_no", "raw")).select(
        "page_id", "url", F.lit(9).alias("detector_no"), F.lit(0).alias("el_no"), "item_no", F.lit("img").alias("source_type"), "raw", null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("string").alias("alt"), null.cast("string").alias("title")
    )


def detect_images(pages: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """Variants of all detectors with page_id, hit_no-making places, img_url, width, height, source_type, alt, title.

    A thumbnail is preceded by its full picture. Only http(s) URLs stay; for anchors only those with an image extension.
    Every page is parsed once: all detectors look at an element in one pass. URLs are resolved in place.
    """
    e = elements if elements is not None else html_elements(pages)
    # An element is looked at by the detectors of its own tag only.
    kinds = [("img", _img() + _lazy()), ("source", _picture()), ("meta", _meta()), ("link", _link_rel()), ("a", _anchor()), ("input", _input())]
    by_tag = reduce(lambda rest, kind: F.when(_tag(kind[0]), F.concat(*kind[1])).otherwise(rest), kinds, F.array().cast(f"array<{_ITEM}>"))
    own = _exploded(e, by_tag, *_background())
    raw = own.unionByName(detect_media_paths(pages))
    hits = raw.withColumn("abs", urls.resolve(F.col("raw"), F.col("url"))).where(urls.is_http_url(F.col("abs")))
    hits = hits.where((F.col("detector_no") != 6) | urls.extension_from_url(F.col("abs")).isin(urls.IMAGE_EXTENSIONS))
    both = F.array_compact(F.array(urls.expand_thumb_url(F.col("abs")), F.col("abs")))
    return hits.select("page_id", "url", "detector_no", "el_no", "item_no", "source_type", "width", "height", "alt", "title", F.posexplode(both).alias("thumb_no", "img_url"))


def pick_primary(variants: Column) -> Column:
    """Of an array of structs with url and width the first without thumb_ in its name, then the widest; ties keep order."""
    keyed = F.transform(variants, lambda v, i: F.struct(v["url"].rlike(r"(?i)/thumb_[^/?#]+([?#]|$)").cast("int").alias("t"), (-F.coalesce(v["width"], F.lit(0))).alias("w"), i.alias("i"), v.alias("v")))
    return F.array_min(keyed)["v"]


def merge_page_hits(variants: DataFrame) -> DataFrame:
    """One row per page and picture: variants (of the first element all, of later ones those with a new key), the primary one
    first, first non-empty alt and title, source_type of the first element.

    variants: as detect_images() gives them. A picture is the variant key of an element's first variant.
    """
    keyed = variants.withColumn("vkey", urls.image_variant_key(F.col("img_url"))).withColumn("own", F.col("source_type"))
    element = ["page_id", "detector_no", "el_no"]
    # Detectors that give each URL by itself count every item as an element.
    keyed = keyed.withColumn("part", F.when(F.col("detector_no") == 9, F.col("item_no")).otherwise(0))
    order = F.struct("item_no", "thumb_no")
    shaped = F.struct(order.alias("o"), F.struct(F.col("img_url").alias("url"), "width", "height", "source_type").alias("v"), "vkey")
    per = keyed.groupBy(*element, "part").agg(F.array_sort(F.collect_list(shaped)).alias("vs"), F.max("alt").alias("alt"), F.max("title").alias("title"))
    per = per.withColumn("first_key", F.col("vs")[0]["vkey"])
    place = F.struct("detector_no", "el_no", "part")
    one = F.struct(place.alias("p"), "vs", F.nullif("alt", F.lit("")).alias("alt"), F.nullif("title", F.lit("")).alias("title"))
    grouped = per.groupBy("page_id", "first_key").agg(F.array_sort(F.collect_list(one)).alias("els"))
    # All of the first element stay; of later ones the first of each new key: one sort by key, one back by place.
    numbered = lambda vs, later: F.transform(vs, lambda x, i: F.struct(x["vkey"].alias("vkey"), F.lit(later).alias("later"), i.alias("i"), x["v"].alias("v")))
    later = F.flatten(F.transform(F.slice("els", 2, F.size("els")), lambda e: e["vs"]))
    both = F.array_sort(F.concat(numbered(F.col("els")[0]["vs"], 0), numbered(later, 1)))
    kept = F.transform(F.filter(F.transform(both, lambda x, i: F.struct(x.alias("x"), (i > 0).alias("inner"), i.alias("i"))), lambda y: (y["x"]["later"] == 0) | ~y["inner"] | (F.get("keyed", y["i"] - 1)["vkey"] != y["x"]["vkey"])), lambda y: y["x"])
    merged = F.transform(F.array_sort(F.transform(kept, lambda x: F.struct(x["later"].alias("later"), x["i"].alias("i"), x["v"].alias("v")))), lambda x: x["v"])
    grouped = grouped.withColumn("keyed", both)
    out = grouped.withColumn("variants", merged).withColumn("primary", pick_primary(F.col("variants")))
    text = lambda f: F.get(F.filter(F.transform("els", lambda e: e[f]), lambda x: x.isNotNull()), F.lit(0))
    return out.select(
        "page_id",
        F.col("primary.url").alias("image_url"),
        F.col("primary.source_type").alias("source_type"),
        F.concat(F.array("primary"), F.filter("variants", lambda v: v != F.col("primary"))).alias("variants"),
        text("alt").alias("alt"),
        text("title").alias("title"),
        F.col("els")[0]["p"].alias("place"),
    )


def source_type_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("page_id", "source_type").agg(F.count("*").alias("n"))


# --- videos

MANIFEST = r"(?i)\.m3u8(\?|$)|\.mpd(\?|$)"


def detect_videos(elements: DataFrame) -> DataFrame:
    """page_id, video_url, source_type, container, mime_type, is_manifest, thumbnail_url, title of <video> and its <source>s;
    each URL once per page, sources before the video's own src."""
    e = elements.where("tag = 'video' or (tag = 'source' and parent = 'video')")
    video = F.col("tag") == "video"
    shown = F.struct(_attr("poster").alias("poster"), F.coalesce(F.nullif(_attr("title"), F.lit("")), _attr("aria-label")).alias("title"))
    # One shuffle by page serves both the look-up of a source's video and the choice among equal URLs.
    e = e.select("page_id", "url", F.when(video, F.col("el_no")).otherwise(F.col("parent_no")).alias("video_no"), "el_no", _attr("src").alias("raw"), _attr("type").alias("type"), F.when(video, "video").otherwise("source").alias("kind"), F.when(video, shown).alias("shown")).repartition("page_id")
    of_video = W.partitionBy("page_id", "video_no").orderBy("el_no").rowsBetween(W.unboundedPreceding, 0)
    both = e.withColumn("shown", F.first("shown").over(of_video)).where("raw <> ''").select("page_id", "url", "video_no", F.when(F.col("kind") == "video", F.lit(2_000_000_000)).otherwise(F.col("el_no")).alias("el_no"), "raw", "type", "shown.*", "kind")
    both = both.withColumn("video_url", urls.normalize_url(F.col("raw"), F.col("url"), keep_fragment=True)).where("video_url is not null")
    w = W.partitionBy("page_id", "video_url").orderBy("video_no", "el_no")
    one = both.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    u, by_type = F.col("video_url"), F.coalesce(F.col("type"), F.lit("")).rlike(r"(?i)mpegurl|dash\+xml") & (F.col("kind") == "source")
    manifest = by_type | u.rlike(MANIFEST)
    ext = urls.extension_from_url(u)
    kind = F.when(urls.is_data_url(u), "data").when(urls.is_blob_url(u), "blob").when(manifest, "hls-js").otherwise(F.col("kind"))
    return one.select(
        "page_id",
        "video_url",
        kind.alias("source_type"),
        F.when(manifest, F.when(F.contains(u, F.lit(".mpd")), "dash").otherwise("hls")).otherwise(urls.container_from_ext(ext)).alias("container"),
        F.coalesce(F.nullif("type", F.lit("")), urls.ext_to_mime(ext)).alias("mime_type"),
        manifest.alias("is_manifest"),
        F.nullif("poster", F.lit("")).alias("thumbnail_url"),
        F.nullif("title", F.lit("")).alias("title"),
    )


def detect_background_videos(elements: DataFrame) -> DataFrame:
    styled = elements.where(F.contains(F.coalesce(_attr("style"), F.lit("")), F.lit("background"))).select("page_id", "url", F.explode(_background_urls()).alias("raw"))
    found = styled.withColumn("video_url", urls.normalize_url(F.col("raw"), F.col("url")))
    kind = urls.container_from_ext(urls.extension_from_url(F.col("video_url")))
    return found.where(kind != "unknown").select("page_id", "video_url", F.lit("background").alias("source_type"), kind.alias("container")).distinct()


def detect_iframe_videos(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Videos of the pages that iframes show, where these are in the page table; page_id of the outer page, iframe_src."""
    frames = elements.where("tag = 'iframe'").where(_attr("src") != "").select("page_id", urls.normalize_url(_attr("src"), F.col("url")).alias("iframe_src")).distinct()
    inner = pages.select(F.col("page_id").alias("inner_id"), urls.without_fragment(F.col("url")).alias("iframe_src"))
    shown = frames.join(inner, "iframe_src")
    videos = detect_videos(elements).withColumnRenamed("page_id", "inner_id")
    return shown.join(videos, "inner_id").drop("inner_id")


_U = r"https?://[^\s\"'<>\\)]"
#: Media URLs in scripts and responses: files and manifests, playback, manifest paths, listed stream hosts.
MEDIA_PATTERNS = [
    rf"(?i){_U}+?\.(?:mp4|m3u8|mpd)(?:\?[^\s\"'<>\\)]*)?",
    rf"(?i){_U}*?videoplayback\?[^\s\"'<>\\)]*",
    rf"(?i){_U}*?/api/manifest/(?:hls_playlist|dash)/[^\s\"'<>\\)]*",
    rf"(?i){_U}+?(?:vkvideo\.ru|vkuservideo\.net|mycdn\.me|vk\.me)[^\s\"'<>\\)]*?(?:m3u8|mpd|/hls/|/live/)[^\s\"'<>\\)]*",
]


def scan_media_urls(responses: DataFrame, patterns: list[str] | None = None, most: int | None = None) -> DataFrame:
    """url, media_url: distinct media URLs in body, with escaped slashes undone and no fragment. Bodies of more than `most`
    characters are left out (MAX_SCRIPT for the usual cap; None: none)."""
    text = F.replace("body", F.lit("\\/"), F.lit("/"))
    small = (responses if most is None else responses.where(F.length("body") <= most)).select("url", text.alias("t"))
    found = F.flatten(F.array(*[F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in patterns or MEDIA_PATTERNS]))
    return small.select("url", F.explode(F.array_distinct(F.transform(found, urls.without_fragment))).alias("media_url"))


def classify_sniffed(df: DataFrame, url: str = "media_url") -> DataFrame:
    """Container and is_manifest of sniffed URLs (job_id, media_url); one that only asks for a range goes if the full one is
    there too, else it becomes the full one."""
    full = urls.normalize_playback_url(F.col(url))
    have = df.select("job_id", F.col(url).alias("_full")).distinct()
    partial = df.withColumn("_full", full)
    kept = partial.where(F.col("_full") == F.col(url)).unionByName(partial.where(F.col("_full") != F.col(url)).join(have, ["job_id", "_full"], "left_anti").select(*partial.columns))
    u = F.col("_full")
    hls, dash = u.rlike(r"(?i)\.m3u8(\?|$)|format=m3u8|/api/manifest/hls_playlist/"), u.rlike(r"(?i)\.mpd(\?|$)|/api/manifest/dash/")
    container = F.when(hls, "hls").when(dash, "dash").when(u.rlike(r"(?i)\.webm(\?|$)"), "webm").otherwise("mp4")
    return kept.select("job_id", u.alias("video_url"), container.alias("container"), (hls | dash).alias("is_manifest")).distinct()


#: Site rules: host expression, source type, expression with one group, container ("" by extension). The key names are fixed
#: values; the hosts are tied to a label's beginning.
SITE_RULES = [
    (r"(?:^|\.)rutube\.ru$", "rutube", r'"(?:video_url|hls_url)"\s*:\s*"([^"]+)"', ""),
    (r"(?:^|\.)(?:vk\.com|vk\.ru|vkvideo\.ru)$", "vk", r'"(?:hls|hls_ondemand|hls_live|hls_live_playback|hls_live_ondemand)"\s*:\s*"([^"]+)"', "hls"),
    (r"(?:^|\.)(?:vk\.com|vk\.ru|vkvideo\.ru)$", "vk", r'"(?:dash_sep|dash_webm|dash_ondemand|dash_live|dash_uni)"\s*:\s*"([^"]+)"', "dash"),
    (r"(?:^|\.)(?:vk\.com|vk\.ru|vkvideo\.ru)$", "vk", r'"url(?:240|360|480|720|1080|1440|2160)"\s*:\s*"([^"]+)"', "mp4"),
    (r"(?:^|\.)ok\.ru$", "ok", r'"(?:hlsManifestUrl|hlsMasterPlaylistUrl)"\s*:\s*"([^"]+)"', "hls"),
    (r"(?:^|\.)coub\.com$", "coub", r'"(?:hd|med|high|low)_url"\s*:\s*"([^"]+)"', "mp4"),
    (r"(?:^|\.)(?:dailymotion\.com|dai\.ly)$", "dailymotion", r'"stream_url"\s*:\s*"([^"]+)"', ""),
    (r"(?:^|\.)twitch\.tv$", "twitch", r'(https://usher\.ttvnw\.net/[^"\'\s]+\.m3u8[^"\'\s]*)', "hls"),
    (r"(?:^|\.)(?:reddit\.com|redd\.it)$", "reddit", r'"contentUrl"\s*:\s*"([^"]+)"', ""),
    (r"(?:^|\.)instagram\.com$", "instagram", r'"(?:video_url|playable_url(?:_quality_hd)?)"\s*:\s*"([^"]+)"', "mp4"),
    (r"(?:^|\.)(?:twitter|x)\.com$", "twitter", r'"url"\s*:\s*"(https:[^"]+video\.twimg\.com[^"]+)"', ""),
    (r"(?:^|\.)facebook\.com$", "facebook", r'"?(?:sd|hd)_src"?\s*:\s*"([^"]+)"', "mp4"),
    (r"(?:^|\.)pinterest\.[a-z.]+$", "pinterest", r'(https://v[0-9]*\.pinimg\.com/[^"\'\s]+)', ""),
    (r"(?:^|\.)bilibili\.com$", "bilibili", r'"baseUrl"\s*:\s*"([^"]+)"', "mp4"),
    (r"(?:^|\.)rumble\.com$", "rumble", r'"url"\s*:\s*"(https:[^"]+(?:rumble|rmbl)[^"]+\.mp4[^"]*)"', "mp4"),
]


def detect_site_videos(pages: DataFrame, rules: list[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """page_id, video_url, source_type, container by the rules of a page's site; the rules are a constant of the plan."""
    chosen = rules or SITE_RULES
    table = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(s).alias("source"), F.lit(x).alias("rx"), F.lit(c).alias("container")) for h, s, x, c in chosen])
    host = urls.hostname_of(F.col("url"))
    known = pages.withColumn("host", host).where(F.col("host").rlike("|".join(sorted({f"(?:{h})" for h, *_ in chosen}))))
    per = known.select("page_id", F.regexp_replace(F.col("html"), r"\\/", "/").alias("t"), F.explode(F.filter(table, lambda r: F.regexp_like(F.col("host"), r["host"]))).alias("r"))
    found = per.select("page_id", "r.source", "r.container", F.explode(F.regexp_extract_all("t", F.col("r.rx"), F.lit(1))).alias("u"))
    url = F.replace("u", F.lit("\\u0026"), F.lit("&"))
    by_ext = urls.container_from_ext(urls.extension_from_url(url))
    return found.select("page_id", url.alias("video_url"), F.col("source").alias("source_type"), F.coalesce(F.nullif("container", F.lit("")), F.nullif(by_ext, F.lit("unknown")), F.lit("mp4")).alias("container")).distinct()


def balanced_json(text: Column, marker: str) -> Column:
    """The JSON object that follows marker, braces balanced outside of strings; null without one."""

    @F.pandas_udf("string")
    def pull(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: _balanced(t, marker))

    return pull(text)


def _balanced(t: str | None, marker: str) -> str | None:
    at = (t or "").find(marker)
    start = t.find("{", at) if at >= 0 else -1
    if start < 0:
        return None
    depth, quoted, i = 0, False, start
    while i < len(t):
        c = t[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return t[start : i + 1]
        i += 1
    return None


def player_response_videos(pages: DataFrame) -> DataFrame:
    """page_id, video_url, container, height, is_drm from the player response in a page's script: manifests and formats;
    formats that need a signature are left out, protected ones flagged."""
    js = balanced_json(F.col("html"), "ytInitialPlayerResponse")
    format_ = "array<struct<url:string,mimeType:string,height:int,signatureCipher:string>>"
    parsed = pages.select("page_id", F.from_json(js, f"streamingData struct<hlsManifestUrl:string,dashManifestUrl:string,formats:{format_},adaptiveFormats:{format_},licenseInfos:array<string>>").alias("j")).where("j is not null")
    d = parsed.select("page_id", "j.streamingData.*")
    null = F.lit(None)
    manifest = lambda c, kind: F.struct(F.col(c).alias("url"), F.lit(kind).alias("container"), null.cast("int").alias("height"))
    of = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(format_)), lambda x: F.struct(x["url"].alias("url"), F.when(F.contains(x["mimeType"], F.lit("webm")), "webm").otherwise("mp4").alias("container"), x["height"].alias("height")))
    rows = F.concat(F.array(manifest("hlsManifestUrl", "hls"), manifest("dashManifestUrl", "dash")), of("formats"), of("adaptiveFormats"))
    return d.select("page_id", (F.size(F.coalesce("licenseInfos", F.array().cast("array<string>"))) > 0).alias("is_drm"), F.explode(rows).alias("x")).where("x.url is not null").select("page_id", F.col("x.url").alias("video_url"), "x.container", "x.height", "is_drm")
