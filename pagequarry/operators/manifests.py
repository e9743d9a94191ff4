"""HLS and DASH manifests as tables of variants and segments.

A playlist is split into numbered lines once; state that runs down the lines (keys, ranges, maps, durations) is windows over
one manifest's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.functions.text import iso_duration_seconds

#: The usual ceilings for segments of a playlist and of a representation; operators read all unless they are given one.
MAX_HLS, MAX_DASH = 120_000, 20_000
#: Segments that one row is expanded to at once.
_PIECE = 10_000


def hls_lines(manifests: DataFrame) -> DataFrame:
    """url, line_no, line of playlists that begin with #EXTM3U."""
    ok = manifests.where(F.col("body").rlike("(?i)^#EXTM3U"))
    return ok.select("url", F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def attribute(line: Column, name: str) -> Column:
    """Value of NAME=value or NAME="value" in a tag; null if absent. The expressions run only on lines that have the name."""
    quoted = F.regexp_extract(line, rf'(?i)(?:^|[:,\s]){name}="([^"]*)"', 1)
    plain = F.trim(F.regexp_extract(line, rf'(?i)(?:^|[:,\s]){name}=([^",]*)', 1))
    return F.when(F.contains(F.upper(line), F.lit(f"{name}=")), F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(plain, F.lit(""))))


def _absolute(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Resolves raw against url in place, without a shuffle; texts that stand absolute already stay as they are."""
    r = F.col(raw)
    http = urls.is_http_url(r)
    return df.withColumn(out, F.when(http, r).otherwise(urls.resolve(F.when(~http, r), F.col("url"), keep_fragment=True)))


#: Lines of a master that are a variant's tag or no tag; no group is repeated, so a playlist may have any number of lines.
_STREAM = r"(?dm)^(#EXT-X-STREAM-INF[^\n]*+|[^#\n][^\n]*+)$"
_AUDIO = r"(?im)^(#EXT-X-MEDIA:[^\n]*TYPE=AUDIO[^\n]*)$"


def _hls_arrays(manifests: DataFrame) -> DataFrame:
    """url, entries: of each master playlist an array of kind (0 variant, 1 sound), no, line, abs, in one pass over its text, with
    their URLs resolved. A variant's URL is the next line that is no tag: every line found is one or the other, so that the
    number of such lines before a tag is its place less the number of tags before it."""
    some = F.contains("body", F.lit("#EXT-X-STREAM-INF")) | F.contains(F.upper("body"), F.lit("#EXT-X-MEDIA:"))
    ok = manifests.where(F.col("body").rlike("(?i)^#EXTM3U") & some)
    b = F.col("lines")
    ok = ok.select("url", F.regexp_replace("body", r"[ \t]*\r?\n[ \t]*", "\n").alias("lines"))
    ok = ok.select("url", F.regexp_extract_all(b, F.lit(_STREAM), F.lit(1)).alias("stream"), F.regexp_extract_all(b, F.lit(_AUDIO), F.lit(1)).alias("sound"))
    is_tag = lambda x: x.startswith("#")
    tagged = F.filter(F.transform("stream", lambda x, i: F.struct(x.alias("line"), i.alias("i"))), lambda x: is_tag(x["line"]))
    ok = ok.select("url", "sound", tagged.alias("tagged"), F.filter("stream", lambda x: ~is_tag(x)).alias("plain"))
    entry = lambda kind, i, line, raw: F.struct(F.lit(kind).alias("kind"), i.alias("no"), line.alias("line"), raw.alias("raw"))
    both = F.concat(F.transform("tagged", lambda x, j: entry(0, j, x["line"], F.get("plain", x["i"] - j))), F.transform("sound", lambda x, i: entry(1, i, x, attribute(x, "URI"))))
    ok = ok.select("url", both.alias("both")).withColumn("abs", urls.resolve_each(F.col("both.raw"), F.col("url")))
    entries = F.zip_with("both", "abs", lambda x, u: F.struct(x["kind"].alias("kind"), x["no"].alias("no"), x["line"].alias("line"), u.alias("abs")))
    return ok.select("url", F.filter(entries, lambda x: x["abs"].isNotNull()).alias("entries"))


def _hls_entries(manifests: DataFrame, kind: int) -> DataFrame:
    """url, place, kind, no, line, abs: the entries of one kind; place numbers them from 0 without those that have no URL."""
    of = F.filter("entries", lambda x: x["kind"] == kind)
    return _hls_arrays(manifests).select("url", F.posexplode(of).alias("place", "x")).select("url", "place", "x.*")


_VARIANT = ["variant_url", "bandwidth", "width", "height", "codecs", "frame_rate", "audio_group", "label"]


def _told(entries: DataFrame, *more: str) -> DataFrame:
    """url, kind, no and more with what a variant's or a track's tag says; every attribute is looked for once."""
    line = F.col("line")
    names = {"size": "RESOLUTION", "band": "BANDWIDTH", "codecs": "CODECS", "rate": "FRAME-RATE", "audio": "AUDIO", "group": "GROUP-ID", "default": "DEFAULT"}
    e = entries.select("url", "kind", "no", *more, F.col("abs").alias("variant_url"), *[attribute(line, tag).alias(n) for n, tag in names.items()])
    w, h = (F.nullif(F.regexp_extract("size", rx, 1).try_cast("int"), F.lit(0)) for rx in ("^([0-9]+)", "x([0-9]+)"))
    e = e.withColumns({"width": w, "height": h, "bandwidth": F.coalesce(F.col("band").try_cast("long"), F.lit(0).cast("long"))})
    size = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    label = F.coalesce(size, F.when(F.col("bandwidth") > 0, F.concat(F.floor(F.col("bandwidth") / 1000 + 0.5).cast("string"), F.lit("kbps"))), F.lit("audio"))
    said = F.coalesce(F.upper("default") == "YES", F.lit(False))
    group = F.when(F.col("kind") == 0, F.col("audio")).otherwise(F.col("group"))
    return e.select("url", "kind", "no", *more, "variant_url", "bandwidth", "width", "height", "codecs", F.col("rate").try_cast("double").alias("frame_rate"), group.alias("audio_group"), label.alias("label"), said.alias("said"))


def parse_hls_master(manifests: DataFrame) -> DataFrame:
    """url, variant_no, variant_url, bandwidth, width, height, codecs, frame_rate, audio_group, label of master playlists."""
    return _told(_hls_entries(manifests, 0), "place").select("url", F.col("place").alias("variant_no"), *_VARIANT)


def hls_audio_groups(manifests: DataFrame) -> DataFrame:
    """url, audio_group, audio_url: the first track of each group, and with a null group the default: the last that says so,
    else the first."""
    tracks = _told(_hls_entries(manifests, 1)).withColumn("last", F.when(F.col("said"), F.col("no")))
    groups = tracks.where("audio_group is not null").groupBy("url", "audio_group").agg(F.min_by("variant_url", "no").alias("audio_url"))
    fallback = tracks.groupBy("url").agg(F.coalesce(F.max_by(F.when(F.col("said"), F.col("variant_url")), "last"), F.min_by("variant_url", "no")).alias("audio_url"))
    return groups.unionByName(fallback.select("url", F.lit(None).cast("string").alias("audio_group"), "audio_url"))


def hls_variants(manifests: DataFrame) -> DataFrame:
    """parse_hls_master() with audio_url and is_audio_only; masters without video get their audio tracks as variants.

    No shuffle: the entries of a playlist stay in one row, where variants look up their sound.
    """
    of = lambda kind: F.filter("entries", lambda x: x["kind"] == kind)
    track = lambda x: F.struct(x["abs"].alias("variant_url"), attribute(x["line"], "GROUP-ID").alias("audio_group"), F.coalesce(F.upper(attribute(x["line"], "DEFAULT")) == "YES", F.lit(False)).alias("said"))
    per = _hls_arrays(manifests).select("url", of(0).alias("video"), of(1).alias("audio")).withColumn("sound", F.transform("audio", track))
    default = F.coalesce(F.get(F.reverse(F.filter("sound", lambda a: a["said"])), F.lit(0))["variant_url"], F.get("sound", F.lit(0))["variant_url"])
    per = per.withColumn("fallback", F.when(F.size("sound") > 0, default))
    rows = per.select("url", "sound", "fallback", (F.size("video") == 0).alias("is_audio_only"), F.posexplode(F.when(F.size("video") > 0, F.col("video")).otherwise(F.col("audio"))).alias("variant_no", "v"))
    rows = _told(rows.select("url", "sound", "fallback", "is_audio_only", "variant_no", "v.*"), "sound", "fallback", "is_audio_only", "variant_no")
    own = F.when((F.size("sound") > 0) & ~F.col("is_audio_only"), F.coalesce(F.get(F.filter("sound", lambda a: a["audio_group"] == F.col("audio_group")), F.lit(0))["variant_url"], F.col("fallback")))
    told = {"bandwidth": F.when(F.col("is_audio_only"), F.lit(128_000)).otherwise(F.col("bandwidth")).cast("long"), "label": F.when(F.col("is_audio_only"), "Audio only").otherwise(F.col("label"))}
    return rows.select("url", "variant_no", *[told.get(n, F.col(n)).alias(n) for n in _VARIANT], own.alias("audio_url"), "is_audio_only")


def parse_hls_media(manifests: DataFrame, most: int | None = None) -> DataFrame:
    """All rows of each, or `most` at most: url, seg_no, seg_url, duration, seq, is_init, key_method, key_uri, key_iv, range_start, range_length of media playlists.

    The key in force is the last key tag's; METHOD=NONE ends it. A range without offset goes on where the one before ended;
    a segment without range starts over. A map tag gives a row (duration 0, seq -1) before the next segment.
    """
    line = F.col("line")
    lines = hls_lines(manifests.where(~F.col("body").rlike(r"(?m)^\s*#EXT-X-STREAM-INF")))
    is_segment = ~line.startswith("#")
    down = W.partitionBy("url").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("seg", F.coalesce(F.sum(is_segment.cast("int")).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # Tags between two segments belong to the second one; the last of each kind counts.
    own = W.partitionBy("url", "seg").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    tag = lambda name, value, over: F.last(F.when(line.startswith(name), value), ignorenulls=True).over(over)
    key = F.struct(F.upper(attribute(line, "METHOD")).alias("method"), attribute(line, "URI").alias("uri"), F.nullif(F.regexp_extract(line, "IV=0x([0-9a-fA-F]+)", 1), F.lit("")).alias("iv"))
    number = lambda rx: F.regexp_extract(line, rx, 1).try_cast("double")
    whole = W.partitionBy("url")
    first_number = lambda name: F.coalesce(F.max(F.when(line.startswith(name), F.regexp_extract(line, r":\s*([0-9]+)", 1).try_cast("long"))).over(whole), F.lit(0))
    state = lines.withColumns(
        {
            "extinf": tag("#EXTINF", F.coalesce(number(r"^#EXTINF:\s*([0-9.]+)"), F.lit(0.0)), own),
            "range": tag("#EXT-X-BYTERANGE", F.trim(F.regexp_extract(line, ":(.*)$", 1)), own),
            "map": tag("#EXT-X-MAP", F.struct(attribute(line, "URI").alias("uri"), attribute(line, "BYTERANGE").alias("range")), own),
            "key": tag("#EXT-X-KEY", key, down),
            "target": first_number("#EXT-X-TARGETDURATION"),
            "base": first_number("#EXT-X-MEDIA-SEQUENCE"),
        }
    ).where(is_segment)
    length, start = (F.regexp_extract("range", rx, 1).try_cast("long") for rx in ("^([0-9]+)", "@([0-9]+)"))
    state = state.withColumns({"length": length, "offset": start})
    # A new run of ranges begins at an explicit offset and after a segment without range.
    order = W.partitionBy("url").orderBy("seg")
    fresh = F.col("offset").isNotNull() | F.col("length").isNull() | F.lag("length").over(order).isNull()
    # In a run, a range begins where its first one does, plus the lengths between: both are read off one running sum.
    state = state.withColumns({"fresh": fresh, "passed": F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    start = F.when(F.col("fresh"), F.coalesce(F.col("offset"), F.lit(0)) - F.col("passed"))
    state = state.withColumn("begin", F.last(start, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("passed"))
    begin = F.col("begin")
    on = F.col("key.method").isin("AES-128", "SAMPLE-AES")
    media = state.select("url", "seg", F.lit(1).alias("part"), F.col("line").alias("raw"), F.coalesce("extinf", F.col("target").cast("double")).alias("duration"), (F.col("base") + F.col("seg")).cast("long").alias("seq"), F.lit(False).alias("is_init"), F.when(on, F.col("key.method")).alias("key_method"), F.when(on, F.col("key.uri")).alias("key_uri"), F.when(on, F.col("key.iv")).alias("key_iv"), F.when(F.col("length").isNotNull(), begin).alias("range_start"), F.col("length").alias("range_length"))
    null = F.lit(None)
    with_offset = F.col("map.range").rlike("@[0-9]+$")
    init = state.where("map.uri is not null").select("url", "seg", F.lit(0).alias("part"), F.col("map.uri").alias("raw"), F.lit(0.0).alias("duration"), F.lit(-1).cast("long").alias("seq"), F.lit(True).alias("is_init"), null.cast("string").alias("key_method"), null.cast("string").alias("key_uri"), null.cast("string").alias("key_iv"), F.when(with_offset, F.regexp_extract("map.range", "@([0-9]+)", 1).try_cast("long")).alias("range_start"), F.when(with_offset, F.regexp_extract("map.range", "^([0-9]+)", 1).try_cast("long")).alias("range_length"))
    own = _absolute(init.unionByName(media).withColumnRenamed("key_uri", "raw_key"), "raw", "seg_url")
    both = _absolute(own, "raw_key", "key_uri").where("seg_url is not null")
    place = W.partitionBy("url").orderBy("seg", "part")
    both = both.withColumn("seg_no", F.row_number().over(place) - 1)
    return (both if most is None else both.where(F.col("seg_no") < most)).select("url", "seg_no", "seg_url", "duration", "seq", "is_init", "key_method", "key_uri", "key_iv", "range_start", "range_length")


def hls_info(manifests: DataFrame) -> DataFrame:
    """url, total_duration (whole seconds), segment_count (with init rows), is_vod, is_encrypted, is_drm, is_fmp4, is_master."""
    ok = manifests.where(F.col("body").rlike("(?i)^#EXTM3U"))
    # Every line, without the blanks around it, follows a line feed; no row to a line is needed.
    ok = ok.select("url", F.concat(F.lit("\n"), F.trim(F.regexp_replace("body", r" *\r?\n *", "\n"))).alias("lines"))
    keys = F.regexp_extract_all("lines", F.lit(r"\n(#EXT-X-(?:SESSION-)?KEY[^\n]*+)"), F.lit(1))
    methods = F.transform(keys, lambda x: F.coalesce(F.upper(attribute(x, "METHOD")), F.lit("")))
    has = lambda tag: F.contains("lines", F.lit(f"\n{tag}"))
    tags = ok.withColumn("methods", methods).groupBy("url").agg(
        F.bool_or(has("#EXT-X-ENDLIST")).alias("ended"),
        F.bool_or(F.array_contains("methods", "AES-128")).alias("is_encrypted"),
        F.bool_or(F.array_contains("methods", "SAMPLE-AES")).alias("is_drm"),
        F.bool_or(has("#EXT-X-MAP")).alias("is_fmp4"),
        F.bool_or(has("#EXT-X-STREAM-INF")).alias("is_master"),
    )
    sums = parse_hls_media(manifests).groupBy("url").agg(F.floor(F.sum("duration") + 0.5).cast("long").alias("total_duration"), F.count("*").alias("segment_count"))
    out = tags.join(sums, "url", "left")
    return out.select("url", F.coalesce("total_duration", F.lit(0).cast("long")).alias("total_duration"), F.coalesce("segment_count", F.lit(0).cast("long")).alias("segment_count"), (F.col("ended") | F.col("is_master")).alias("is_vod"), "is_encrypted", "is_drm", "is_fmp4", "is_master")


def xml_attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf"(?i)(?:^|\s){name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def dash_info(manifests: DataFrame) -> DataFrame:
    """url, is_live, duration, is_drm of MPD documents."""
    mpd = manifests.where(F.col("body").rlike(r"(?i)<MPD[\s>]"))
    tag = F.regexp_extract("body", r"(?is)<MPD([^>]*)>", 1)
    protect = F.array_join(F.regexp_extract_all("body", F.lit(r"(?is)(<ContentProtection[^>]*>)"), F.lit(1)), " ")
    return mpd.select("url", F.coalesce(F.lower(xml_attribute(tag, "type")) == "dynamic", F.lit(False)).alias("is_live"), iso_duration_seconds(F.coalesce(xml_attribute(tag, "mediaPresentationDuration"), F.lit(""))).alias("duration"), protect.rlike("(?i)edef8ba9|9a04f079|94ce86fb|widevine|playready|fairplay|clearkey").alias("is_drm"))


def dash_representations(manifests: DataFrame) -> DataFrame:
    """One row per representation with its sets' and periods' fall-backs: everything that segments need, and best URL parts."""
    mpd = manifests.where(F.col("body").rlike(r"(?i)<MPD[\s>]"))
    top = F.regexp_extract("body", r"(?is)<MPD([^>]*)>", 1)
    scope = F.regexp_extract("body", r"(?is)<MPD[^>]*>(.*?)<Period", 1)
    base = F.nullif(F.trim(F.regexp_extract(scope, r"(?is)<BaseURL>([^<]+)</BaseURL>", 1)), F.lit(""))
    periods = F.regexp_extract_all("body", F.lit(r"(?is)(<Period\b.*?(?:</Period>|$))"), F.lit(1))
    p = mpd.select("url", base.alias("mpd_base"), iso_duration_seconds(F.coalesce(xml_attribute(top, "mediaPresentationDuration"), F.lit(""))).alias("mpd_duration"), F.posexplode(periods).alias("period_no", "period"))
    head = F.regexp_extract("period", r"(?is)^<Period([^>]*)>", 1)
    sets = F.regexp_extract_all("period", F.lit(r"(?is)(<AdaptationSet\b[^>]*?(?:/>|>.*?</AdaptationSet>))"), F.lit(1))
    a = p.select("url", "mpd_base", F.when(xml_attribute(head, "duration").isNotNull(), iso_duration_seconds(xml_attribute(head, "duration"))).otherwise(F.col("mpd_duration")).alias("period_duration"), "period_no", F.posexplode(sets).alias("set_no", "aset"))
    set_tag = F.regexp_extract("aset", r"(?is)^<AdaptationSet([^>]*?)/?>", 1)
    reps = F.regexp_extract_all("aset", F.lit(r"(?is)(<Representation\b[^>]*?(?:/>|>.*?</Representation>))"), F.lit(1))
    # The set's own template stands outside of its representations.
    bare = F.regexp_replace("aset", r"(?is)<Representation\b[^>]*?(?:/>|>.*?</Representation>)", "")
    r = a.select("url", "mpd_base", "period_duration", "period_no", "set_no", set_tag.alias("set_tag"), bare.alias("set_body"), F.posexplode(reps).alias("rep_no", "rep"))
    tag = F.regexp_extract("rep", r"(?is)^<Representation([^>]*?)/?>", 1)
    template = lambda c: F.nullif(F.regexp_extract(c, r"(?is)<SegmentTemplate([^>]*)>", 1), F.lit(""))
    timeline = lambda c: F.nullif(F.regexp_extract(c, r"(?is)<SegmentTimeline[^>]*>(.*?)</SegmentTimeline>", 1), F.lit(""))
    r = r.select("*", tag.alias("tag"), F.coalesce(template("rep"), template("set_body")).alias("tpl"), F.coalesce(timeline("rep"), timeline("set_body")).alias("timeline"))
    mime = F.coalesce(xml_attribute(F.col("set_tag"), "mimeType"), F.lit(""))
    content = F.coalesce(xml_attribute(F.col("set_tag"), "contentType"), F.when(mime.startswith("video"), "video").when(mime.startswith("audio"), "audio"))
    t, n = F.col("tag"), lambda c, name, kind: xml_attribute(c, name).try_cast(kind)
    tpl = F.col("tpl")
    return r.select(
        "url", "period_no", "set_no", "rep_no",
        F.coalesce(xml_attribute(t, "id"), F.concat_ws("-", F.lit("r"), "period_no", "set_no", "rep_no")).alias("rep_id"),
        F.coalesce(n(t, "bandwidth", "long"), F.lit(0).cast("long")).alias("bandwidth"),
        F.nullif(n(t, "width", "int"), F.lit(0)).alias("width"), F.nullif(n(t, "height", "int"), F.lit(0)).alias("height"),
        F.regexp_extract(F.coalesce(xml_attribute(t, "frameRate"), F.lit("")), "^([0-9.]+)", 1).try_cast("double").alias("frame_rate"),
        F.coalesce(xml_attribute(t, "codecs"), xml_attribute(F.col("set_tag"), "codecs")).alias("codecs"),
        F.coalesce(content == "audio", F.lit(False)).alias("is_audio_only"),
        "mpd_base", F.nullif(F.trim(F.regexp_extract("rep", r"(?is)<BaseURL(?:\s[^>]*)?>([^<]+)</BaseURL>", 1)), F.lit("")).alias("rep_base"),
        xml_attribute(tpl, "initialization").alias("init"), xml_attribute(tpl, "media").alias("media"),
        F.coalesce(n(tpl, "timescale", "double"), F.lit(1.0)).alias("timescale"), n(tpl, "duration", "double").alias("seg_duration"),
        F.coalesce(n(tpl, "startNumber", "int"), F.lit(1)).alias("start_number"), "period_duration", "timeline",
    )


def fill_template(template: Column, rep_id: Column, bandwidth: Column, number: Column | None = None, time: Column | None = None) -> Column:
    """$RepresentationID$, $Bandwidth$, $Number$, $Time$, the last two also as $Number%05d$; missing ones are empty."""
    out = F.replace(F.replace(template, F.lit("$RepresentationID$"), rep_id), F.lit("$Bandwidth$"), bandwidth.cast("string"))
    for name, value in (("Number", number), ("Time", time)):
        text = F.lit("") if value is None else value.cast("long").cast("string")
        width = F.regexp_extract(template, rf"\${name}%0([0-9]+)d\$", 1)
        padded = F.lpad(text, F.greatest(F.length(text), F.coalesce(width.try_cast("int"), F.lit(0))), F.lit("0"))
        out = F.replace(F.replace(out, F.concat(F.lit(f"${name}%0"), width, F.lit("d$")), padded), F.lit(f"${name}$"), text)
    return out


def _dash_url(df: DataFrame, raw: str, out: str) -> DataFrame:
    """Resolves raw against the representation's and the document's base, in place."""
    base = F.coalesce(F.when(urls.is_http_url(F.col("mpd_base")), F.col("mpd_base")), F.col("url"))
    inner = F.when(urls.is_http_url(F.col("rep_base")), F.col("rep_base"))
    return df.withColumn(out, urls.resolve(F.col(raw), F.coalesce(inner, base), keep_fragment=True))


def parse_dash(manifests: DataFrame) -> DataFrame:
    """url, variant_no, variant_url, bandwidth, width, height, codecs, frame_rate, is_audio_only, label, rep_id."""
    r = dash_representations(manifests)
    i, b = F.col("rep_id"), F.col("bandwidth")
    first = F.coalesce(F.when(F.col("rep_base").isNotNull(), F.lit(".")), fill_template(F.col("init"), i, b), fill_template(F.col("media"), i, b, F.lit(1), F.lit(0)), F.lit("."))
    r = r.withColumn("raw", F.when(F.col("rep_base").isNotNull() & ~urls.is_http_url(F.col("rep_base")), F.col("rep_base")).otherwise(first))
    r = _dash_url(r, "raw", "variant_url")
    label = F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat_ws("x", "width", "height")).when(F.col("is_audio_only"), "Audio only").otherwise(F.concat(F.floor(b / 1000 + 0.5).cast("string"), F.lit("kbps")))
    order = W.partitionBy("url").orderBy("period_no", "set_no", "rep_no")
    return r.select("url", (F.row_number().over(order) - 1).alias("variant_no"), "variant_url", "bandwidth", "width", "height", "codecs", "frame_rate", "is_audio_only", label.alias("label"), "rep_id")


_KEYS = ["url", "period_no", "set_no", "rep_no"]


#: A URL with one place for a number or a time and no other dollar sign.
_ONE_TOKEN = r"^([^$]*)\$(Number|Time)(?:%0([0-9]+)d)?\$([^$]*)\z"


def _templates(reps: DataFrame) -> DataFrame:
    """reps with init_url and media_url: the templates, filled but for number and time and resolved once per representation.
    What is filled in later is digits, which no resolution changes."""
    i, b = F.col("rep_id"), F.col("bandwidth")
    init = fill_template(F.col("init"), i, b)
    media = F.replace(F.replace("media", F.lit("$RepresentationID$"), i), F.lit("$Bandwidth$"), b.cast("string"))
    widths = {f"{name} width": F.coalesce(F.regexp_extract("media", rf"\${name}%0([0-9]+)d\$", 1), F.lit("")) for name in ("Number", "Time")}
    out = _dash_url(_dash_url(reps.withColumns({"raw init": init, "raw media": media, **widths}), "raw init", "init_url"), "raw media", "media_url")
    part = lambda i: F.regexp_extract("media_url", _ONE_TOKEN, i)
    alone = (part(2) != "") & (part(3) == F.when(part(2) == "Number", F.col("Number width")).otherwise(F.col("Time width")))
    return out.withColumns({"only token": F.when(alone, part(2)), "before token": part(1), "after token": part(4), "token width": F.coalesce(part(3).try_cast("int"), F.lit(0))})


def _spread(reps: DataFrame) -> DataFrame:
    """reps in as many partitions as a shuffle has: a row may become thousands of segments."""
    return reps.repartition(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_KEYS)


def _segment_url(number: Column, time: Column) -> Column:
    """media_url with number and time; the widths are read once per representation, and where only one place is to be filled, the
    texts around it too."""
    only = F.when(F.col("only token") == "Number", number).otherwise(time).cast("long").cast("string")
    short = F.concat("before token", F.lpad(only, F.greatest(F.length(only), F.col("token width")), F.lit("0")), "after token")
    out = F.col("media_url")
    for name, value in (("Number", number), ("Time", time)):
        text = value.cast("long").cast("string")
        width = F.col(f"{name} width")
        padded = F.lpad(text, F.greatest(F.length(text), F.coalesce(width.try_cast("int"), F.lit(0))), F.lit("0"))
        out = F.when(width != "", F.replace(out, F.concat(F.lit(f"${name}%0"), width, F.lit("d$")), padded)).otherwise(out)
        out = F.replace(out, F.lit(f"${name}$"), text)
    return F.when(F.col("only token").isNotNull(), short).otherwise(out)


def _with_init(rows: DataFrame, filled: Column) -> DataFrame:
    """The result's columns of rows, of which each representation's number 0 is its init segment. They come from the same pass, as
    a union with the representations would have every document parsed and dealt out a second time."""
    is_init = F.col("seg_no") == 0
    return rows.where(is_init | F.col("media_url").isNotNull()).select("url", "rep_id", "seg_no", is_init.alias("is_init"), F.when(is_init, F.col("init_url")).otherwise(filled).alias("seg_url"))


def _numbered(df: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row of df n times, name numbering its copies from 1; in two steps, so that no array is long."""
    pieces = df.withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _PIECE))).alias("_piece"))
    one = F.sequence(F.col("_piece") * _PIECE + 1, F.least(F.col("_n"), (F.col("_piece") + 1) * _PIECE))
    return pieces.select(*df.columns, F.explode(one).alias(name))


def dash_segments(reps: DataFrame, most: int | None = None) -> DataFrame:
    """url, rep_id, seg_no, is_init, seg_url by duration and start number: an init row, then one per started duration of the
    period, `most` at most if that is given; one if the period's length is unknown."""
    r = _templates(_spread(reps.where("init is not null and media is not null and timeline is null and seg_duration > 0")))
    step = F.col("seg_duration") / F.col("timescale")
    total = F.when(F.col("period_duration") > 0, F.ceil(F.col("period_duration") / step)).otherwise(1).cast("long")
    rows = _numbered(r, (total if most is None else F.least(total, F.lit(most))) + 1, "seg_no").withColumn("seg_no", (F.col("seg_no") - 1).cast("int"))
    number = F.col("start_number") + F.col("seg_no") - 1
    return _with_init(rows, _segment_url(number, F.floor((number - 1) * step + 0.5)))


def dash_timeline_segments(reps: DataFrame, most: int | None = None) -> DataFrame:
    """The same from a timeline: entries S with t (start), d (duration), r (repeats; below 0 counts as 0)."""
    r = _templates(_spread(reps.where("init is not null and media is not null and timeline is not null")))
    entries = F.regexp_extract_all("timeline", F.lit(r"(?is)<S\b([^>]*?)/?>"), F.lit(1))
    s = r.select("*", F.posexplode(F.concat(F.array(F.lit("")), entries)).alias("s_no", "s"))  # entry 0 has no length: the init segment
    num = lambda n: xml_attribute(F.col("s"), n).try_cast("long")
    s = s.withColumns({"t": num("t"), "d": F.coalesce(num("d"), F.lit(0)), "r": F.greatest(F.coalesce(num("r"), F.lit(0)), F.lit(0))})
    s = s.withColumn("whole", F.when(F.col("d") > 0, F.col("d") * (F.col("r") + 1)).otherwise(0))
    w = W.partitionBy(*_KEYS).orderBy("s_no")
    s = s.withColumn("run", F.count("t").over(w))
    run = W.partitionBy(*_KEYS, "run").orderBy("s_no")
    start = F.coalesce(F.first("t").over(run), F.lit(0)) + F.coalesce(F.sum("whole").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r") + 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumns({"start": start, "before": before}).where("d > 0 or s_no = 0")
    k = _numbered(s, F.col("r") + 1, "k").withColumn("k", F.col("k") - 1)
    k = k.withColumn("seg_no", F.when(F.col("s_no") == 0, 0).otherwise(F.col("before") + F.col("k") + 1).cast("int"))
    return _with_init(k if most is None else k.where(F.col("seg_no") <= most), _segment_url(F.col("seg_no"), F.col("start") + F.col("k") * F.col("d")))


def best_variant(variants: DataFrame, video_only: bool = False) -> DataFrame:
    """The variant of the largest bandwidth per manifest, the first of equals; with video_only sound counts only alone."""
    rank = [F.col("bandwidth"), -F.col("variant_no")]
    if video_only:
        rank = [(~F.col("is_audio_only")).cast("int"), *rank]
    return variants.groupBy("url").agg(F.max_by(F.struct(*[c for c in variants.columns if c != "url"]), F.struct(*rank)).alias("v")).select("url", "v.*")


def apply_variant_choice(cands: DataFrame, choices: DataFrame) -> DataFrame:
    """cands with video_url, bitrate_kbps, width, height of an explicit choice by id."""
    names = ["video_url", "bitrate_kbps", "width", "height"]
    c = choices.select("id", *[F.col(n).alias(f"_{n}") for n in names])
    return cands.join(c, "id", "left").select(*[F.coalesce(f"_{n}", n).alias(n) if n in names else F.col(n) for n in cands.columns])


def expand_manifests(cands: DataFrame, manifests: DataFrame) -> DataFrame:
    """cands (id, video_url) with the best variant of their master and the totals of the playlist that is played: best_url,
    bandwidth, duration, segment_count, is_live, estimated_size."""
    best = best_variant(hls_variants(manifests)).select(F.col("url").alias("video_url"), F.col("variant_url").alias("best_url"), "bandwidth")
    info = hls_info(manifests).where("not is_master").select(F.col("url").alias("play_url"), F.col("total_duration").alias("duration"), "segment_count", (~F.col("is_vod")).alias("is_live"))
    out = cands.join(best, "video_url", "left").withColumn("play_url", F.coalesce("best_url", "video_url")).join(info, "play_url", "left").drop("play_url")
    return out.withColumn("estimated_size", F.floor(F.col("bandwidth") / 8 * F.col("duration") + 0.5).cast("long"))


def segment_plan(segments: DataFrame) -> DataFrame:
    """Segments (url, is_audio, seg_no, seg_url, is_init, range_start, range_length) in order of fetching: each init once,
    sound after the picture of the same place; range_header as sent."""
    same = W.partitionBy("url", "is_audio", "is_init", "seg_url").orderBy("seg_no")
    all_ = segments.withColumn("_same", F.row_number().over(same)).where(~F.col("is_init") | (F.col("_same") == 1)).drop("_same")
    w = W.partitionBy("url").orderBy("seg_no", "is_audio")
    header = F.when(F.col("range_start").isNotNull(), F.concat(F.lit("bytes="), F.col("range_start").cast("string"), F.lit("-"), (F.col("range_start") + F.col("range_length") - 1).cast("string")))
    return all_.select("url", (F.row_number().over(w) - 1).alias("fetch_no"), "seg_url", "is_audio", "is_init", header.alias("range_header"))


def manifest_outcome(ok: Column, is_drm: Column, is_encrypted: Column, key_uri: Column, variants: Column, segments: Column) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), "parse_error").when(is_drm, "drm").when(is_encrypted & key_uri.isNull(), "no_key").when((variants == 0) & (segments == 0), "no_variants").when(segments == 0, "no_segments").otherwise("ok")
