"""File names, titles and human-readable figures on columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def nfc(c: Column) -> Column:
    """Composed Unicode form; the one step of a file name that Spark has no function for."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return compose(c)


def sanitize_filename(c: Column, kind: str = "image", compose: bool = False) -> Column:
    """image: no <>:"/\\|?* or controls, blanks squeezed, else "image". video: also no emoji or zero-width characters, no dots,
    dashes, blanks at the ends, 120 characters, else "video"; compose=True puts it into composed form first."""
    squeezed = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    bare = F.regexp_replace(nfc(c) if compose else c, r'[<>:"/\\|?*\x00-\x1F]', "")
    if kind == "image":
        return F.coalesce(F.nullif(squeezed(bare), F.lit("")), F.lit("image"))
    bare = F.regexp_replace(bare, r"[\x{10000}-\x{10FFFF}\x{FE0F}\x{FEFF}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2064}\x{7F}-\x{9F}]", "")
    bare = F.regexp_replace(F.regexp_replace(squeezed(bare), r"^[.\s_\-]+", ""), r"[.\s_\-]+$", "")
    return F.coalesce(F.nullif(F.left(bare, F.lit(120)), F.lit("")), F.lit("video"))


def apply_filename_template(template: str, today: str, title: Column, domain: Column, width: Column, height: Column, duration: Column, quality: Column, ext: Column, format: Column) -> Column:
    """The template's placeholders filled in; unknown ones and nulls are empty, the holes they leave collapse."""
    number = lambda c: F.coalesce(F.nullif(F.floor(c + 0.5).cast("long"), F.lit(0)).cast("string"), F.lit(""))
    name = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(sanitize_filename(c, "video"))
    known = {"title": name(title), "domain": name(domain), "width": number(width), "height": number(height), "duration": number(duration), "quality": name(quality), "ext": F.lower(F.coalesce(F.nullif(ext, F.lit("")), F.lit("mp4"))), "format": name(format), "date": F.lit(today)}
    parts = re.split(r"\{(\w+)\}", template)
    out = F.concat(*[F.lit(p) if i % 2 == 0 else known.get(p, F.lit("")) for i, p in enumerate(parts)])
    for rx, to in ((r"[_\-\s]{2,}", "_"), (r"^[\s_\-]+", ""), (r"[\s_\-]+(?=\.)", ""), (r"[\s_\-]+$", "")):
        out = F.regexp_replace(out, rx, to)
    out = F.when(out.startswith("."), F.concat(F.lit("video"), out)).otherwise(out)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("video"))


def _fixed(x: Column, digits: int) -> Column:
    """x with so many decimals, ties upwards, by whole-number arithmetic."""
    scale = 10**digits
    n = F.floor(x * scale + 0.5).cast("long")
    return F.concat(F.floor(n / scale).cast("long").cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))


def format_bytes(c: Column) -> Column:
    k = 1024.0
    known = F.when(c < k, F.concat(c.cast("long").cast("string"), F.lit(" B"))).when(c < k**2, F.concat(_fixed(c / k, 1), F.lit(" KB"))).when(c < k**3, F.concat(_fixed(c / k**2, 1), F.lit(" MB"))).otherwise(F.concat(_fixed(c / k**3, 2), F.lit(" GB")))
    return F.when(c.isNull() | (c < 0), DASH).otherwise(known)


def _hms(c: Column) -> tuple[Column, Column, Column]:
    t = F.floor(c + 0.5).cast("long")
    return F.floor(t / 3600).cast("long"), F.floor((t % 3600) / 60).cast("long"), t % 60


def format_duration(c: Column) -> Column:
    """h:mm:ss or m:ss from seconds."""
    h, m, s = _hms(c)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    known = F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s))).otherwise(F.concat_ws(":", m.cast("string"), two(s)))
    return F.when(c.isNull() | (c < 0), DASH).otherwise(known)


def format_duration_words(c: Column, units: tuple[str, str, str] = ("ч", "мин", "с")) -> Column:
    h, m, s = _hms(c)
    say = lambda *p: F.concat_ws(" ", *[x for n, u in p for x in (n.cast("string"), F.lit(u))])
    known = F.when(h > 0, say((h, units[0]), (m, units[1]))).when(m > 0, say((m, units[1]), (s, units[2]))).otherwise(say((s, units[2])))
    return F.when(c.isNull() | (c <= 0), "").otherwise(known)


def format_bitrate(c: Column, units: tuple[str, str] = ("Кбит/с", "Мбит/с")) -> Column:
    known = F.when(c < 1000, F.concat_ws(" ", F.floor(c + 0.5).cast("long").cast("string"), F.lit(units[0]))).otherwise(F.concat_ws(" ", _fixed(c / 1000, 1), F.lit(units[1])))
    return F.when(c.isNull(), DASH).otherwise(known)


def format_resolution(w: Column, h: Column) -> Column:
    return F.when((F.coalesce(w, F.lit(0)) > 0) & (F.coalesce(h, F.lit(0)) > 0), F.concat(w.cast("long").cast("string"), F.lit("×"), h.cast("long").cast("string"))).otherwise(DASH)


def is_obscure_title(c: Column) -> Column:
    """Whether a title says nothing: missing, a fixed name, a URL, a manifest's file name."""
    t = F.lower(F.trim(c))
    # Titles that say nothing.
    fixed = t.isin("video", "video.m3u8", "master.m3u8", "index.m3u8", "playlist.m3u8", "стена | вконтакте", "вконтакте", "vk", "видеозаписи", "стена")
    return F.coalesce(c, F.lit("")).eqNullSafe("") | fixed | t.rlike(r"^(videoplayback|https?://|expires/[0-9])|^dash_[0-9_.]+\.mpd$|^hls_[0-9_.]+\.m3u8$")


def iso_duration_seconds(c: Column) -> Column:
    """Seconds of PT#H#M#S; 0 for anything else."""
    whole = r"^PT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9.]+)S)?$"
    part = lambda i: F.coalesce(F.regexp_extract(c, whole, i).try_cast("double"), F.lit(0.0))
    return F.when(c.rlike(whole), part(1) * 3600 + part(2) * 60 + part(3)).otherwise(0.0)
