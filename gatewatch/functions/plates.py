"""Plate text: normalisation, parsing, correction and status as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Region codes of plates, and the characters that readers confuse.
REGIONS = (
    "A AA AB AD AE AG B BA BB BD BE BG BH BK BL BM BN BP BR BT CC CD D DA DB DC DD DE DG DH DK DL DM DN DP DR DT DW "
    "E EA EB ED F G H K KB KH KT KU L M N P PA PB PD PS PT PY R RI S T W Z"
).split()
DIGITS_AS_LETTERS = ("0125689", "OIZSGBg")
LETTERS_AS_DIGITS = ("OQDILJZSGB", "0001112568")
READABLE_QUALITY = 0.45

PLATE = r"^([A-Z]{1,2})([0-9]{1,4})([A-Z]{0,3})$"
SPLIT = r"^([A-Z0-9]{1,2})([A-Z0-9]{1,4})([A-Z0-9]{0,3})$"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(text: Column) -> Column:
    """Upper-case letters and digits only; null counts as empty."""
    return F.regexp_replace(F.upper(F.trim(F.coalesce(text, F.lit("")))), "[^A-Z0-9]", "")


def known_region(code: Column) -> Column:
    return code.isin(REGIONS)


def parse(text: Column) -> Column:
    """struct<prefix,number,suffix> of a well-formed plate with a known region and a number other than zero, else null."""

    def parts(t: Column) -> Column:
        prefix, number, suffix = (F.regexp_extract(t, PLATE, i) for i in (1, 2, 3))
        return F.when(known_region(prefix) & number.rlike("[1-9]"), F.struct(prefix.alias("prefix"), number.alias("number"), suffix.alias("suffix")))

    return let(normalize(text), parts)


def penalty(original: Column, corrected: Column) -> Column:
    """Characters changed; for another length, its difference plus two."""
    lengths = F.length(original) - F.length(corrected)
    changed = F.size(F.filter(F.zip_with(F.split(original, ""), F.split(corrected, ""), lambda a, b: a != b), lambda x: x))
    return F.when(lengths != 0, F.abs(lengths) + 2).otherwise(changed)


def _prefixes(raw: Column) -> Column:
    as_letters = F.translate(raw, *DIGITS_AS_LETTERS)
    first, second = F.substring(raw, 1, 1), F.substring(raw, 2, 1)
    tried = F.array(as_letters, F.when(F.length(raw) == 2, first), F.when(F.length(raw) == 2, second))
    return F.when(known_region(raw), F.array(raw)).otherwise(F.array_distinct(F.filter(tried, lambda x: x.isNotNull() & known_region(x))))


def _numbers(raw: Column) -> Column:
    tried = F.filter(F.array(F.translate(raw, *LETTERS_AS_DIGITS), raw), lambda x: x.rlike("^[0-9]+$"))
    return F.array_distinct(F.filter(F.transform(tried, lambda x: F.regexp_replace(x, "^0+", "")), lambda x: x != ""))


def _suffixes(raw: Column) -> Column:
    tried = F.array_distinct(F.array(F.translate(raw, *DIGITS_AS_LETTERS), raw))
    return F.when(raw == "", F.array(F.lit(""))).otherwise(F.filter(tried, lambda x: x.rlike("^[A-Za-z]+$")))


def correct(text: Column) -> Column:
    """struct<original,corrected,valid,penalty,candidates>: the plate that is the fewest confusions away.

    One greedy split into region, number and series; every part is tried as read and with its confusions undone. Candidates are
    ordered by changes, then length (longer first), then as tried; at most two changes, and two in five characters, are valid."""

    def result(o: Column, corrected: Column, valid: Column, ratio: Column, candidates: Column) -> Column:
        return F.struct(o.alias("original"), corrected.alias("corrected"), valid.alias("valid"), ratio.cast("double").alias("penalty"), candidates.alias("candidates"))

    def tried(o: Column) -> Column:
        prefix, number, suffix = (F.regexp_extract(o, SPLIT, i) for i in (1, 2, 3))
        crossed = F.flatten(F.transform(_prefixes(prefix), lambda p: F.flatten(F.transform(_numbers(number), lambda n: F.transform(_suffixes(suffix), lambda s: F.concat(p, n, s))))))
        formed = F.filter(crossed, lambda c: c.rlike(PLATE))
        ranked = F.transform(formed, lambda c, i: F.struct(penalty(o, c).alias("cost"), (-F.length(c)).alias("short"), i.alias("i"), c.alias("text")))
        return F.array_sort(ranked)

    def judged(o: Column) -> Column:
        none = F.array().cast("array<string>")
        refused = result(o, o, F.lit(False), F.lit(0.0), none)
        bad = (F.length(o) < 2) | (F.length(o) > 9) | ~o.rlike("[A-Z]") | ~o.rlike("[0-9]") | o.rlike("^[0-9]{3}")
        stripped = F.regexp_replace(o, "^([A-Z]{1,2})0+([1-9])", "$1$2")
        as_read = F.when(stripped == o, result(o, o, F.lit(True), F.lit(0.0), F.array(o))).otherwise(result(o, stripped, F.lit(True), F.lit(0.1), F.array(stripped)))

        def best(ranked: Column) -> Column:
            top = F.get(ranked, F.lit(0))
            ratio = top["cost"] / F.length(o)
            found = result(o, top["text"], (top["cost"] <= 2) & (ratio <= 0.40), ratio, F.transform(F.slice(ranked, 1, 5), lambda r: r["text"]))
            return F.when(F.size(ranked) == 0, refused).otherwise(found)

        return F.when(bad, refused).when(parse(o).isNotNull(), as_read).when(~o.rlike(SPLIT), refused).otherwise(let(tried(o), best))

    return let(normalize(text), judged)


def is_valid(text: Column) -> Column:
    return correct(text)["valid"]


def canonical(text: Column) -> Column:
    """The corrected plate if valid, else the normalised text."""
    return let(correct(text), lambda r: F.when(r["valid"], r["corrected"]).otherwise(r["original"]))


def looks_like_plate(text: Column) -> Column:
    """Whether a text has the shape of a plate, of 3 to 9 characters, whatever its region."""
    return let(normalize(text), lambda t: F.length(t).between(3, 9) & t.rlike(PLATE))


def display(text: Column) -> Column:
    """Region, number and series with spaces between; other texts as they are."""
    groups = [F.regexp_extract(normalize(text), PLATE, i) for i in (1, 2, 3)]
    return F.when(parse(text).isNotNull(), F.concat_ws(" ", *[F.when(g != "", g) for g in groups])).otherwise(text)


def region_code(text: Column) -> Column:
    """The longest known region, of two letters or one, that something follows."""
    return let(
        normalize(text),
        lambda t: F.when((F.length(t) > 2) & known_region(F.substring(t, 1, 2)), F.substring(t, 1, 2)).when((F.length(t) > 1) & known_region(F.substring(t, 1, 1)), F.substring(t, 1, 1)),
    )


def status(plate: Column, confidence: Column, quality: Column) -> Column:
    """1 readable, 2 to be reviewed, 0 failed."""
    clean = F.trim(F.coalesce(plate, F.lit("")))
    sure = (F.coalesce(confidence, F.lit(0.0)) >= 0.70) & F.coalesce(quality >= READABLE_QUALITY, F.lit(False))
    judged = let(correct(clean), lambda r: F.when(~r["valid"], F.when(F.size(r["candidates"]) > 0, 2).otherwise(0)).when(sure, 1).otherwise(2))
    return F.when(clean.isin("", "-"), 0).otherwise(judged)


def face_status(confidence: Column) -> Column:
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(c >= 0.65, 1).when(c >= 0.40, 2).otherwise(0)


def vehicle_recurrence(count: Column, has_plate: Column) -> Column:
    return F.when(~has_plate | (F.coalesce(count, F.lit(0)) <= 1), "NORMAL").when(count <= 5, "SERING_MUNCUL").otherwise("MENCURIGAKAN")


def person_recurrence(count: Column) -> Column:
    return F.when(count == 1, "NORMAL").when(count.between(2, 5), "SERING_MUNCUL").otherwise("MENCURIGAKAN")


def person_identity(event_key: Column, track_id: Column) -> Column:
    """The third part of a person's key; else the track; else the key."""
    key = F.trim(F.coalesce(event_key, F.lit("")))
    parts = F.filter(F.split(key, ":"), lambda p: ~p.isin("", " "))
    track = F.concat(F.lit("track:"), track_id.cast("string"))
    named = (F.size(parts) >= 3) & (F.lower(F.get(parts, F.lit(0))) == "person")
    return F.when(key == "", track).when(named, F.get(parts, F.lit(2))).otherwise(F.coalesce(track, key))


def is_vehicle_plate(text: Column) -> Column:
    cleaned = normalize(text)
    return (F.length(cleaned) >= 2) & cleaned.rlike("[A-Z]") & cleaned.rlike("[0-9]") & is_valid(text)


def vehicle_identity(plate: Column, event_key: Column, track_id: Column, camera_id: Column) -> Column:
    """The canonical plate; else the camera and the key without its generation; else the track."""
    camera = F.coalesce(F.concat(F.lit("cam"), camera_id.cast("string"), F.lit("_")), F.lit(""))
    key = F.trim(F.coalesce(event_key, F.lit("")))
    by_key = F.concat(camera, F.regexp_replace(key, ":(?:gen|g)[0-9]+", ""))
    return F.when(is_vehicle_plate(plate), canonical(plate)).when(key != "", by_key).otherwise(F.concat(F.lit("track:"), camera, track_id.cast("string")))


def is_tax_date(text: Column) -> Column:
    """A month and year of tax validity: 08.28, 11-27, .28 or 0828."""
    t = F.trim(text)
    month, year = F.substring(t, 1, 2).try_cast("int"), F.substring(t, 3, 2).try_cast("int")
    plain = t.rlike("^[0-9]{4}$") & month.between(1, 12) & year.between(20, 38)
    return t.rlike(r"^[0-9]{1,2}[.\-/\s][0-9]{2}$") | t.rlike(r"^[.\-/][0-9]{2}$") | F.coalesce(plain, F.lit(False))


# The second list of regions, its corrections, and the characters that the segmenter confuses.
SEGMENT_REGIONS = "A AA AB AD AE AG B BA BB BD BE BG BH BK BL BM BN BP D DA DB DC DD DE DG DH DK DL DM DN DP DR DT E EA EB ED F G H K KB KH KT KU L M N P PA PB R S T W Z".split()
SEGMENT_CORRECTIONS = {"AR": "AB", "AP": "AB", "AQ": "AB", "AO": "AD", "AC": "AD", "AL": "AB"}
SEGMENT_TO_DIGITS = ("BODQCILJZSGAT", "8000011125647")
SEGMENT_TO_LETTERS = ("8012345679", "BOIZEASGTP")


def to_digits(text: Column) -> Column:
    return F.translate(F.upper(text), *SEGMENT_TO_DIGITS)


def to_letters(text: Column) -> Column:
    return F.translate(F.upper(text), *SEGMENT_TO_LETTERS)


def enumerated(text: Column) -> Column:
    """struct<text,applied,score>: every split into one or two letters, one to four digits and up to three letters, each part with its
    look-alikes undone; the split with the fewest changes wins, on ties the shorter region and number. A change costs 0.12."""

    def best(raw: Column) -> Column:
        found = []
        for letters in (1, 2):
            for digits in (1, 2, 3, 4):
                made = F.concat(to_letters(F.substr(raw, F.lit(1), F.lit(letters))), to_digits(F.substr(raw, F.lit(letters + 1), F.lit(digits))), to_letters(F.substr(raw, F.lit(letters + digits + 1))))
                changes = F.size(F.filter(F.zip_with(F.split(raw, ""), F.split(made, ""), lambda a, b: a != b), lambda x: x))
                fits = F.length(raw).between(letters + digits, letters + digits + 3) & made.rlike(PLATE)
                found.append(F.when(fits, F.struct(changes.alias("changes"), F.lit(len(found)).alias("i"), made.alias("text"))))
        return let(F.array_min(F.array(*found)), lambda r: F.struct(
            F.coalesce(r["text"], raw).alias("text"), F.coalesce(r["text"] != raw, F.lit(False)).alias("applied"), F.coalesce(F.greatest(F.lit(0.0), 1 - 0.12 * r["changes"]), F.lit(0.0)).alias("score"),
        ))

    return let(normalize(text), best)


def _segment_prefix(raw: Column) -> Column:
    letters = to_letters(raw)
    fixed = F.create_map(*[F.lit(x) for kv in SEGMENT_CORRECTIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(fixed, letters), letters)


def segment(text: Column) -> Column:
    """struct<text,formatted,valid,known>: the most plausible cut of a reading into region, number and series.

    Texts with spaces are taken at their word where that fits. Otherwise every cut with one or two letters and one to four
    digits is scored: a known region, few changes and parts that are letters or digits already count; ten points are needed."""
    singles = [r for r in SEGMENT_REGIONS if len(r) == 1]
    pair_heads = sorted({r[0] for r in SEGMENT_REGIONS if len(r) == 2})

    def result(t: Column, shown: Column, valid, known) -> Column:
        flag = lambda v: F.lit(v) if isinstance(v, bool) else v
        return F.struct(t.alias("text"), shown.alias("formatted"), flag(valid).alias("valid"), flag(known).alias("known"))

    def joined(p: Column, n: Column, s: Column) -> Column:
        return F.concat_ws(" ", p, n, F.when(s != "", s))

    def changed(a: Column, b: Column) -> Column:
        return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y) & x.isNotNull() & y.isNotNull()), lambda v: v))

    def cut(c: Column, k: int, n: int, rank: Column) -> Column:
        p_raw, n_raw, s_raw = F.substring(c, 1, k), F.substring(c, k + 1, n), F.substring(c, k + n + 1, 12)
        p, number, s = _segment_prefix(p_raw), to_digits(n_raw), to_letters(s_raw)
        fits = (F.length(c) >= k + 2) & (F.length(c) > k + n) & number.rlike("^[0-9]+$") & ((s_raw == "") | s.rlike("^[A-Z]{1,3}$"))
        known = p.isin(SEGMENT_REGIONS)
        moves = changed(p_raw, p) + changed(n_raw, number) + F.when(s_raw != "", changed(s_raw, s)).otherwise(0)
        points = F.when(known, 15).when(F.substring(p, 1, 1).isin(pair_heads), 5).otherwise(0) + F.when(moves == 0, 10).otherwise(-4 * moves)
        points = points + (F.when(p_raw.isin(singles), 5).otherwise(0) if k == 1 else 0) + F.when(p.rlike("^[A-Z]+$"), 3).otherwise(0) + 6
        points = points + F.when(n_raw.rlike("^[0-9]+$"), 3).otherwise(0) + F.when(s_raw.rlike("^[A-Z]+$"), 3).otherwise(0)
        return F.when(fits, F.struct(points.alias("points"), (-(rank * 10 + (4 - n))).alias("order"), result(F.concat(p, number, s), joined(p, number, s), True, known).alias("r")))

    def whole(c: Column) -> Column:
        single_first = F.substring(c, 1, 1).isin(singles) & F.substring(c, 2, 1).rlike(f"[0-9{SEGMENT_TO_DIGITS[0]}]")
        rank = {1: F.when(single_first, 0).otherwise(1), 2: F.when(single_first, 1).otherwise(0)}
        best = F.array_max(F.filter(F.array(*[cut(c, k, n, rank[k]) for k in (1, 2) for n in (4, 3, 2, 1)]), lambda x: x.isNotNull()))

        def chosen(b: Column) -> Column:
            bare = c.rlike("^[0-9]{1,4}[A-Z]{1,3}$")
            shown = F.regexp_replace(c, "^([0-9]{1,4})([A-Z]{1,3})$", "$1 $2")
            rest = F.when(bare, result(c, shown, True, False)).otherwise(result(c, c, F.length(c).between(3, 10), False))
            return F.when(F.coalesce(b["points"] >= 10, F.lit(False)), b["r"]).otherwise(rest)

        return let(best, chosen)

    def spaced(parts: Column, c: Column) -> Column:
        p, n = _segment_prefix(F.get(parts, F.lit(0))), to_digits(F.get(parts, F.lit(1)))
        s = to_letters(F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), ""))
        three = (F.size(parts) >= 3) & p.isin(SEGMENT_REGIONS) & n.rlike("^[0-9]+$") & s.rlike("^[A-Z]{1,3}$")
        tail = to_letters(F.get(parts, F.lit(1)))
        two = (F.size(parts) == 2) & F.get(parts, F.lit(0)).rlike("^[0-9]{1,4}$") & tail.rlike("^[A-Z]{1,3}$")
        by_two = result(F.concat(F.get(parts, F.lit(0)), tail), F.concat_ws(" ", F.get(parts, F.lit(0)), tail), True, False)
        return F.when(three, result(F.concat(p, n, s), joined(p, n, s), True, True)).when(two, by_two).otherwise(whole(c))

    def judged(c: Column) -> Column:
        parts = F.filter(F.split(F.upper(F.trim(F.coalesce(text, F.lit("")))), r"[\s.\-]+"), lambda x: x != "")
        return F.when(~F.length(c).between(3, 12), result(c, c, False, False)).otherwise(let(parts, lambda x: spaced(x, c)))

    return let(normalize(text), judged)
