"""Converters, labels and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(*columns: Column) -> Column:
    """The first value that is neither null, zero nor blank, else the last one."""
    return F.coalesce(*[F.when((c.cast("string") != "") & ~c.cast("string").rlike(r"^[+-]?0*\.?0*(E[+-]?\d+)?$"), c) for c in columns[:-1]], columns[-1])


def to_number(text: Column) -> Column:
    """A number, also from `74.6%` and `0,5`; null otherwise."""
    return F.regexp_replace(F.replace(F.trim(text), F.lit(","), F.lit(".")), "%$", "").try_cast("double")


def percent(share: Column) -> Column:
    """A share between 0 and 1, or a percentage already, as a percentage with one decimal."""
    return F.round(F.when(share <= 1, share * 100).otherwise(share), 1)


def status_label(status: Column, unclear: str = "Perlu Cek") -> Column:
    """The label of reports; listings write the middle one in lower case."""
    return F.when(status == 1, "Terbaca").when(status == 2, unclear).otherwise("Gagal")


def confidence_colour(confidence: Column) -> Column:
    return F.when(confidence >= 0.70, "green").otherwise("yellow")


def lighting(brightness: Column, contrast: Column, dark: Column, glare: Column) -> Column:
    """struct<score,status> of a region by its mean and spread of grey levels and its shares of dark and of glaring pixels."""
    bright_score = F.greatest(F.lit(0.0), 100.0 - F.abs(brightness - 125.0) * 0.75)
    score = 0.65 * bright_score + 0.35 * F.least(F.lit(100.0), contrast * 2.0) - glare * 80.0
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    status = F.when(brightness.isNull(), "NO ROI").when(glare >= 0.18, "GLARE").when(brightness < 45, "TOO DARK").when(brightness < 72, "LOW LIGHT").when(brightness > 205, "OVEREXPOSED").when(score >= 72, "GOOD").otherwise("FAIR")
    return F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), status.alias("status"))


def focused_lighting(brightness: Column, contrast: Column, dark: Column, bright: Column) -> Column:
    """struct<score,status> of a video's region in focus; dark and bright are the shares of pixels under 35 and over 242."""
    level = F.when(brightness < 65, 35.0 * brightness / 65).when(brightness <= 175, 100.0).when(brightness <= 205, 100.0 - (brightness - 175) / 30 * 35).otherwise(F.greatest(F.lit(15.0), 65.0 - (brightness - 205) / 50 * 50))
    spread = F.least(F.lit(100.0), F.greatest(F.lit(0.0), contrast / 55 * 100))
    score = level * 0.55 + spread * 0.30 + (100 - F.least(F.lit(45.0), bright * 180)) * 0.10 + (100 - F.least(F.lit(35.0), dark * 70)) * 0.05
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    status = F.when(brightness.isNull(), "NO ROI").when((brightness < 45) | (dark > 0.45), "TOO DARK").when((brightness < 65) | (contrast < 24), "LOW LIGHT").when((bright > 0.10) | (brightness > 205), "OVEREXPOSED")
    status = status.when(bright > 0.05, "GLARE").when(score >= 80, "GOOD").when(score >= 60, "FAIR").otherwise("POOR")
    return F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), status.alias("status"))


def camera_status(status: Column) -> Column:
    return F.when(status == 1, "Aktif").otherwise("Nonaktif")


def dotted(number: Column) -> Column:
    """A whole number with points between thousands."""
    return F.translate(F.format_number(number, 0), ",", ".")


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_")


def capture_path(prefix: str, camera: Column, at: Column, track: Column) -> Column:
    """Deterministic capture name in its date's folder."""
    return F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit(f"/{prefix}_cam"), camera.cast("string"), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.coalesce(track.cast("string"), F.lit("na")), F.lit(".jpg"))


def stream_url(url: Column) -> Column:
    """A trimmed stream address with its scheme in lower case; a bare host gets rtsp://, a bare number is a device."""
    t = F.trim(url)
    scheme = F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    return F.when(t.rlike("^[0-9]+$") | (t == ""), t).when(scheme != "", F.concat(F.lower(scheme), F.substring(t, F.length(scheme) + 1, F.length(t)))).otherwise(F.concat(F.lit("rtsp://"), t))


def contains(column: Column, text: str) -> Column:
    """Substring search without regard to case; % and _ are plain characters."""
    return F.contains(F.upper(F.coalesce(column, F.lit(""))), F.lit(text.upper()))
