"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import geometry as G
from ..functions import plates as P
from ..functions import text as X
from ..sources import tables as T

NORMAL = "regexp_replace(upper(trim(text)), '[^A-Z0-9]', '', 'g')"
REGION = "(" + "|".join(f"'{r}'" for r in P.REGIONS).replace("|", ", ") + ")"
SHAPE = "'^([A-Z]{1,2})([0-9]{1,4})([A-Z]{0,3})$'"
PARSED = f", n as (select reading_id, text, confidence, crop_quality, {NORMAL} as t from readings), q as (select *, regexp_extract(t, {SHAPE}, 1) as prefix, regexp_extract(t, {SHAPE}, 2) as num, regexp_extract(t, {SHAPE}, 3) as suffix, regexp_matches(t, {SHAPE}) and regexp_extract(t, {SHAPE}, 1) in {REGION} as ok from n) "
AB = "from boxes a join boxes b using (frame) where a.kind = 'plate' and b.kind = 'vehicle'"


@query("sf01_normalized", f"select reading_id, {NORMAL} as t from readings")
def normalized(spark, sf):
    return T.readings(spark, sf).select("reading_id", P.normalize(F.col("text")).alias("t"))


@query("sf02_parsed", PARSED + "select reading_id, case when ok then prefix end as prefix, case when ok then num end as number, case when ok then suffix end as suffix from q")
def parsed(spark, sf):
    return T.readings(spark, sf).select("reading_id", P.parse(F.col("text")).alias("p")).select("reading_id", "p.*")


@query(
    "sf04_corrected",
    PARSED
    + """, s as (select *, translate(regexp_extract(t, '^([A-Z0-9]{1,2})([A-Z0-9]{1,4})([A-Z0-9]{0,3})$', 1), '0125689', 'OIZSGBg') as p2, regexp_extract(t, '^([A-Z0-9]{1,2})([A-Z0-9]{1,4})([A-Z0-9]{0,3})$', 2) as m, regexp_extract(t, '^([A-Z0-9]{1,2})([A-Z0-9]{1,4})([A-Z0-9]{0,3})$', 3) as s from q)
select reading_id, coalesce(ok, false) as well_formed from s""",
)
def well_formed(spark, sf):
    """Whether the text is a plate as it stands (its correction costs nothing)."""
    r = P.correct(F.col("text"))
    return T.readings(spark, sf).select("reading_id", (r["valid"] & (r["penalty"] == 0)).alias("well_formed"))


#: The correction in steps: what each of the three parts may be, in order, then all combinations by changes, length and order.
CUT = "'^([A-Z0-9]{1,2})([A-Z0-9]{1,4})([A-Z0-9]{0,3})$'"
CORRECTION = f""", n as (select reading_id, {NORMAL} as o from readings),
p as (select o, regexp_extract(o, {CUT}, 1) as a, regexp_extract(o, {CUT}, 2) as b, regexp_extract(o, {CUT}, 3) as s, regexp_extract(o, '^([A-Z]{{1,2}})([0-9]{{1,4}})([A-Z]{{0,3}})$', 1) in {REGION} and regexp_matches(o, '^[A-Z]+0*[1-9]') as known,
length(o) between 2 and 9 and regexp_matches(o, '[A-Z]') and regexp_matches(o, '[0-9]') and not regexp_matches(o, '^[0-9][0-9][0-9]') as able from (select distinct o from n)),
ra as (select o, 0 as i, a as r from p where a in {REGION} union all select o, 1, translate(a, '0125689', 'OIZSGBg') from p where a not in {REGION}
union all select o, 2, substr(a, 1, 1) from p where a not in {REGION} and length(a) = 2 union all select o, 3, substr(a, 2, 1) from p where a not in {REGION} and length(a) = 2),
rb as (select o, r, min(i) as i from ra where r in {REGION} group by 1, 2),
ma as (select o, 0 as i, translate(b, 'OQDILJZSGB', '0001112568') as m from p union all select o, 1, b from p),
mb as (select o, ltrim(m, '0') as m, min(i) as i from ma where regexp_full_match(m, '[0-9]+') and ltrim(m, '0') <> '' group by 1, 2),
sa as (select o, 0 as i, translate(s, '0125689', 'OIZSGBg') as s from p union all select o, 1, s from p),
sb as (select o, s, min(i) as i from sa where regexp_full_match(s, '[A-Za-z]*') group by 1, 2),
c as (select rb.o, rb.r || mb.m || sb.s as c, rb.i as i, mb.i as j, sb.i as k from rb join mb using (o) join sb using (o) where regexp_full_match(rb.r || mb.m || sb.s, '[A-Z]{{1,2}}[0-9]{{1,4}}[A-Z]{{0,3}}')),
k as (select *, case when length(c) = length(o) then hamming(o, c) else abs(length(o) - length(c)) + 2 end as cost from c),
best as (select o, list(c order by cost, length(c) desc, i, j, k) as found, min(cost) as cost from k group by o),
done as (select p.o, case when not able then o when known then regexp_replace(o, '^([A-Z]{{1,2}})0+([1-9])', '\\1\\2') when found is null then o else found[1] end as corrected,
able and (known or found is not null and cost <= 2 and cost / length(o)::double <= 0.40) as valid, case when able and known then case when regexp_matches(o, '^[A-Z]+0') then 0.1 else 0.0 end when able and found is not null then cost / length(o)::double else 0.0 end as penalty,
case when not able then '' when known then regexp_replace(o, '^([A-Z]{{1,2}})0+([1-9])', '\\1\\2') else coalesce(array_to_string(found[1:5], ','), '') end as candidates from p left join best using (o))
"""


#: Votes over readings as they are: positions, lengths, then the support of the chosen text; `done` holds each vote's correction.
VOTED = f""", vr as (select track_id, reading_id, text, confidence, coalesce(crop_quality, 0.5) as crop_quality, greatest(0.05, confidence) * (0.5 + 0.5 * coalesce(crop_quality, 0.5)) as w, length(text) as n from readings where text <> ''),
ch as (select track_id, n, i as pos, substr(text, cast(i as int), 1) as c, sum(w) as cw, max(confidence) as cc, min(reading_id) as f from (select *, unnest(range(1, n + 1)) as i from vr) group by all),
win as (select track_id, n, pos, arg_max(c, row(round(cw, 12), cc, -f)) as c, arg_max(cw, row(round(cw, 12), cc, -f)) as won, sum(cw) as tot from ch group by all),
made as (select track_id, n, string_agg(c, '' order by pos) as vote, avg(won / tot) as consensus, max(tot) as gw from win group by all)""" + CORRECTION.replace("from readings)", "from (select distinct 0 as reading_id, vote as text from made))", 1) + f""",
judged as (select m.*, d.valid, d.corrected, d.penalty from made m join done d on d.o = {NORMAL.replace("text", "m.vote")}),
pick as (select * from judged qualify row_number() over (partition by track_id order by round(gw * case when valid then 1.08 else 1.0 end, 12) desc, valid desc, n) = 1),
ag as (select vr.*, p.vote, p.consensus, p.valid, p.corrected, p.penalty, 1 - hamming(vr.text, p.vote) / vr.n::double as agree from vr join pick p on p.track_id = vr.track_id and p.n = vr.n),
su as (select *, max(agree >= 0.75) over (partition by track_id) as backed from ag),
voted as (select track_id, any_value(vote) as text, any_value(consensus) as consensus, any_value(valid) as valid, any_value(corrected) as corrected, any_value(penalty) as penalty, count(*) as reads, count_if(text = vote) as exact,
sum(case when backed and agree >= 0.75 then confidence * w * agree when not backed then confidence * w end) / sum(case when not backed or agree >= 0.75 then w end) * any_value(consensus) as confidence from su group by track_id),
stable as (select v.*, (select count(*) from vr where vr.track_id = v.track_id) as total, valid and reads >= 2 and consensus >= 0.70 and confidence >= 0.65 and (exact >= 2 or consensus >= 0.85) as stable from voted v)
"""


@query("sf04_candidates", CORRECTION + "select reading_id, corrected, valid, round(penalty, 6) as penalty, candidates from n join done using (o)")
def candidates(spark, sf):
    return T.readings(spark, sf).select("reading_id", P.correct(F.col("text")).alias("r")).select("reading_id", "r.corrected", "r.valid", F.round("r.penalty", 6).alias("penalty"), F.array_join("r.candidates", ",").alias("candidates"))


CONFUSED = "case plate_id % 6 when 0 then translate(plate_number, '01258', 'OIZSB') when 1 then replace(plate_number, 'CD', '0D') when 2 then concat('0', plate_number) when 3 then replace(replace(plate_number, 'D', '0'), 'B', '8') when 4 then concat(plate_number, '5') else concat('Z', plate_number) end"


@query("sf05_confused", CORRECTION.replace("from readings)", f"from (select plate_id as reading_id, {CONFUSED} as text from plates))", 1) + "select reading_id, corrected, valid, round(penalty, 6) as penalty, candidates from n join done using (o)")
def confused(spark, sf):
    """SF-3 to SF-5 on texts with confused, missing and added characters."""
    rows = T.plates(spark, sf).selectExpr("plate_id as reading_id", f"{CONFUSED} as text").select("reading_id", P.correct(F.col("text")).alias("r"))
    return rows.select("reading_id", "r.corrected", "r.valid", F.round("r.penalty", 6).alias("penalty"), F.array_join("r.candidates", ",").alias("candidates"))


@query("sf03_penalties", CORRECTION + "select penalty_of, count(*) as n, count_if(valid) as valid from (select round(penalty, 6) as penalty_of, valid from n join done using (o)) group by 1")
def penalties(spark, sf):
    """SF-5: readings by what their correction costs."""
    r = T.readings(spark, sf).select(P.correct(F.col("text")).alias("r")).select(F.round("r.penalty", 6).alias("penalty_of"), "r.valid")
    return r.groupBy("penalty_of").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"))


@query("sf07_display", PARSED + "select reading_id, case when ok then concat_ws(' ', prefix, num, nullif(suffix, '')) else text end as shown from q")
def display(spark, sf):
    return T.readings(spark, sf).select("reading_id", P.display(F.col("text")).alias("shown"))


@query("sf09_region", f", n as (select reading_id, {NORMAL} as t from readings) select reading_id, case when length(t) > 2 and substr(t, 1, 2) in {REGION} then substr(t, 1, 2) when length(t) > 1 and substr(t, 1, 1) in {REGION} then substr(t, 1, 1) end as region from n")
def region(spark, sf):
    return T.readings(spark, sf).select("reading_id", P.region_code(F.col("text")).alias("region"))


@query("sf10_plate_status", "select plate_id, case when ocr_confidence >= 0.7 and plate_crop_quality >= 0.45 then 1 else 2 end as status from plates")
def plate_status(spark, sf):
    return T.plates(spark, sf).select("plate_id", P.status(F.col("plate_number"), F.col("ocr_confidence"), F.col("plate_crop_quality")).alias("status"))


@query("sf11_face_status", "select detection_id, case when detection_confidence >= 0.65 then 1 when detection_confidence >= 0.40 then 2 else 0 end as status from detections")
def face_status(spark, sf):
    return T.detections(spark, sf).select("detection_id", P.face_status(F.col("detection_confidence")).alias("status"))


@query("sf12_recurrence_status", "select plate_number, case when count(*) <= 1 then 'NORMAL' when count(*) <= 5 then 'SERING_MUNCUL' else 'MENCURIGAKAN' end as status from plates group by 1")
def recurrence_status(spark, sf):
    return T.plates(spark, sf).groupBy("plate_number").agg(F.count("*").alias("n")).select("plate_number", P.vehicle_recurrence(F.col("n"), F.lit(True)).alias("status"))


@query("sf15_vehicle_identity", "select detection_id, case when plate_number is not null then plate_number when event_key is not null and trim(event_key) <> '' then concat('cam', camera_id, '_', trim(event_key)) else concat('track:cam', camera_id, '_', track_id) end as identity from detections d left join plates p using (plate_id)")
def vehicle_identity(spark, sf):
    rows = T.detections(spark, sf).join(T.plates(spark, sf).select("plate_id", "plate_number"), "plate_id", "left")
    return rows.select("detection_id", P.vehicle_identity(F.col("plate_number"), F.col("event_key"), F.col("track_id"), F.col("camera_id")).alias("identity"))


@query("sf17_tax_dates", "select s, regexp_matches(s, '^[0-9]{1,2}[./ -][0-9]{2}$') or regexp_matches(s, '^[./-][0-9]{2}$') or (regexp_matches(s, '^[0-9]{4}$') and cast(substr(s, 1, 2) as int) between 1 and 12 and cast(substr(s, 3, 2) as int) between 20 and 38) as tax from (select distinct concat(lpad(cast(track_id % 14 as varchar), 2, '0'), case when track_id % 3 = 0 then '.' else '' end, lpad(cast(track_id % 50 as varchar), 2, '0')) as s from detections)")
def tax_dates(spark, sf):
    s = T.detections(spark, sf).selectExpr("concat(lpad(cast(track_id % 14 as string), 2, '0'), case when track_id % 3 = 0 then '.' else '' end, lpad(cast(track_id % 50 as string), 2, '0')) as s").distinct()
    return s.select("s", P.is_tax_date(F.col("s")).alias("tax"))


@query("sf21_iou", f"select a.box_id as a, b.box_id as b, round(i / (({'(a.x2 - a.x1) * (a.y2 - a.y1)'}) + ({'(b.x2 - b.x1) * (b.y2 - b.y1)'}) - i), 6) as iou from (select a, b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) as i {AB})")
def iou(spark, sf):
    from ..operators.joins import _pairs

    b = T.boxes(spark, sf)
    return _pairs(b.filter("kind = 'plate'"), b.filter("kind = 'vehicle'")).select(F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b"), F.round(G.iou(G.box("a_"), G.box("b_")), 6).alias("iou"))


@query("sf23_centres", "select box_id, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, y2 as bottom from boxes")
def centres(spark, sf):
    (cx, cy), (_, bottom) = G.center(G.box()), G.bottom_center(G.box())
    return T.boxes(spark, sf).select("box_id", cx.alias("cx"), cy.alias("cy"), bottom.alias("bottom"))


@query("sf24_sides", "select box_id, cast(sign((490 - 10) * (y2 - 120) - (140 - 120) * ((x1 + x2) / 2 - 10)) as int) as side from boxes")
def sides(spark, sf):
    x, y = G.bottom_center(G.box())
    at = [F.lit(float(v)) for v in (10, 120, 490, 140)]
    return T.boxes(spark, sf).select("box_id", G.side_of_line(x, y, *at).alias("side"))


@query("sf25_zones", """, z(zone, x1, y1, x2, y2, ord) as (values ('NEAR', 0.0::double, 300.0::double, 800.0::double, 500.0::double, 1), ('MID', 100.0::double, 150.0::double, 700.0::double, 300.0::double, 2)),
s as (select b.box_id, z.zone, z.ord, greatest(least(b.x2, z.x2) - greatest(b.x1, z.x1), 0) * greatest(least(b.y2, z.y2) - greatest(b.y1, z.y1), 0) as inside, (b.x2 - b.x1) * (b.y2 - b.y1) as own, (z.x2 - z.x1) * (z.y2 - z.y1) as whole,
(b.x1 + b.x2) / 2 >= z.x1 and (b.x1 + b.x2) / 2 < z.x2 and ((b.y1 + b.y2) / 2 >= z.y1 and (b.y1 + b.y2) / 2 < z.y2 or b.y2 >= z.y1 and b.y2 < z.y2) as middle from boxes b, z)
select box_id, coalesce(min_by(zone, ord) filter (where inside / own >= 0.25 or inside / whole >= 0.30 or middle and inside / own >= 0.20), 'FAR') as zone from s group by box_id""")
def zones(spark, sf):
    """NEAR, MID or FAR of every box in a frame of 800 by 500."""
    polygon = lambda *p: F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in p])
    near, mid = polygon((0.0, 300.0), (800.0, 300.0), (800.0, 500.0), (0.0, 500.0)), polygon((100.0, 150.0), (700.0, 150.0), (700.0, 300.0), (100.0, 300.0))
    return T.boxes(spark, sf).select("box_id", G.zone_of(G.box(), near, mid).alias("zone"))


@query("sf25_clipped", """select box_id, round(greatest(0, least(x2, 400) - greatest(x1, 100)) * greatest(0, least(y2, 250) - greatest(y1, 50)), 6) as rectangle,
round(case when (x1 + y1) >= 420 then 0 when x2 + y2 <= 420 then (x2 - x1) * (y2 - y1) else power(420 - x1 - y1, 2) / 2 - power(greatest(0, 420 - x2 - y1), 2) / 2 - power(greatest(0, 420 - x1 - y2), 2) / 2 end, 6) as triangle from boxes""")
def clipped(spark, sf):
    """Areas of a rectangle and of a large triangle inside every box."""
    polygon = lambda *p: F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in p])
    rectangle, triangle = polygon((100.0, 50.0), (400.0, 50.0), (400.0, 250.0), (100.0, 250.0)), polygon((-1000.0, -1000.0), (1420.0, -1000.0), (-1000.0, 1420.0))
    return T.boxes(spark, sf).select("box_id", F.round(G.clip_area(G.box(), rectangle), 6).alias("rectangle"), F.round(G.clip_area(G.box(), triangle), 6).alias("triangle"))


@query("sf26_polygons", "select camera_id, round(abs((0.1 + 0.02 * camera_id) * 0.5) , 6) as area from cameras")
def polygons(spark, sf):
    w = (0.1 + 0.02 * F.col("camera_id")).cast("double")
    p = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(w, F.lit(0.0)), F.array(w, F.lit(0.5)), F.array(F.lit(0.0), F.lit(0.5)))
    return T.cameras(spark, sf).select("camera_id", F.round(G.shoelace(p), 6).alias("area"))


@query("sf27_hamming", "select detection_id, bit_count(xor(cast('0x' || substr(md5(cast(detection_id as varchar)), 1, 16) as ubigint), cast('0x' || substr(md5(cast(track_id as varchar)), 1, 16) as ubigint))::bit)::int as bits from detections")
def hamming(spark, sf):
    h = lambda c: F.substring(F.md5(F.col(c).cast("string").cast("binary")), 1, 16)
    return T.detections(spark, sf).select("detection_id", G.hamming(h("detection_id"), h("track_id")).alias("bits"))


@query("sf28_crop_quality", "select plate_id, round(0.45 * ocr_confidence + 0.30 * plate_crop_quality + 0.15 * 0.5 + 0.10 * 1.0, 6) as quality from plates")
def crop_quality(spark, sf):
    return T.plates(spark, sf).select("plate_id", F.round(G.crop_quality(F.col("ocr_confidence"), F.col("plate_crop_quality"), F.lit(0.5), F.lit(2.0)), 6).alias("quality"))


#: Sizes and pixel statistics of crops, made of the readings' numbers.
CROPS = ["plate_id", "cast(plate_id % 300 as double) as w", "cast(plate_id % 97 as double) as h", "ocr_confidence * 220 as sharp", "plate_crop_quality * 60 as spread"]
UNIT = "greatest(0::double, least(1::double, {}))"


@query("sf28_pixel_quality", f""", k as (select {", ".join(CROPS)} from plates)
select plate_id, round(case when h >= 6 and w >= 12 then 0.45::double * {UNIT.format("sharp / 180")} + 0.30::double * {UNIT.format("w * h / 12288")} + 0.15::double * {UNIT.format("spread / 40")} + 0.10::double * case when w / greatest(h, 1) between 1.8 and 4.8 then 1 else 0.75::double end else 0 end + 1e-10::double, 6) as quality,
round(0.55::double * {UNIT.format("w * h / 12288")} + 0.45::double * {UNIT.format("sharp / 150")} + 1e-10::double, 6) as reread from k""")
def pixel_quality(spark, sf):
    """SF-28: crops by their pixels, in both variants; a trifle is added so that no value lies between two roundings."""
    k = T.plates(spark, sf).selectExpr(*CROPS)
    w, h, sharp = F.col("w"), F.col("h"), F.col("sharp")
    return k.select("plate_id", F.round(G.pixel_quality(w, h, sharp, F.col("spread")) + 1e-10, 6).alias("quality"), F.round(G.reread_quality(w, h, sharp) + 1e-10, 6).alias("reread"))


@query("sf29_focused", """, m as (select event_id, c * 0.255::double as b, cast((c * 7) % 80 as double) as s, (c % 13) / 20.0::double as d, case when c % 11 = 0 then 0.3::double else (c % 10) / 100.0::double end as g from e),
v as (select *, least(100::double, greatest(0::double, 0.55::double * case when b < 65 then 35 * b / 65 when b <= 175 then 100 when b <= 205 then 100 - (b - 175) / 30 * 35 else greatest(15, 65 - (b - 205) / 50 * 50) end + 0.30::double * least(100, s / 55 * 100) + 0.10::double * (100 - least(45, g * 180)) + 0.05::double * (100 - least(35, d * 70)))) as score from m)
select event_id as detection_id, round(score, 9) as score, case when b < 45 or d > 0.45 then 'TOO DARK' when b < 65 or s < 24 then 'LOW LIGHT' when g > 0.10 or b > 205 then 'OVEREXPOSED' when g > 0.05 then 'GLARE' when score >= 80 then 'GOOD' when score >= 60 then 'FAIR' else 'POOR' end as status from v""")
def focused(spark, sf):
    """SF-29: the lighting of a video's focus."""
    c = F.round(F.col("detection_confidence") * 1000).cast("int")
    glare = F.when(c % 11 == 0, 0.3).otherwise((c % 10) / 100.0)
    found = X.focused_lighting(c * 0.255, ((c * 7) % 80).cast("double"), (c % 13) / 20.0, glare)
    return T.detections(spark, sf).select("detection_id", found.alias("l")).select("detection_id", F.round("l.score", 9).alias("score"), "l.status")


@query("sf29_focus_score", "select box_id, round(confidence * 0.40::double + least(1::double, (x2 - x1) * (y2 - y1) / 400000 / 0.12::double) * 0.35::double + greatest(0::double, 1 - sqrt(power((x1 + x2) / 2 - 400, 2) + power((y1 + y2) / 2 - 300, 2)) / sqrt(890000::double)) * 0.17::double + case when kind = 'vehicle' then 0.08::double else 0 end, 9) as score from boxes")
def focus_score(spark, sf):
    """SF-29: which box of a frame of 800 by 500 deserves the focus at (400, 300)."""
    return T.boxes(spark, sf).select("box_id", F.round(G.focus_score(G.box(), F.col("confidence"), F.col("kind") == "vehicle", 800.0, 500.0, (400.0, 300.0)), 9).alias("score"))


@query("sf20_shapes", f", n as (select reading_id, {NORMAL} as t from readings) select reading_id, t as normal, length(t) between 3 and 9 and regexp_full_match(t, '[A-Z]{{1,2}}[0-9]{{1,4}}[A-Z]{{0,3}}') as shaped from n")
def shapes(spark, sf):
    """SF-20: the validator without regions."""
    return T.readings(spark, sf).select("reading_id", P.normalize(F.col("text")).alias("normal"), P.looks_like_plate(F.col("text")).alias("shaped"))


@query("sf30_event_score", "select plate_id, round(0.45 * ocr_confidence + 0.30 * ocr_confidence + 0.25 * plate_crop_quality, 6) as score from plates")
def event_score(spark, sf):
    return T.plates(spark, sf).select("plate_id", F.round(G.event_score(F.col("ocr_confidence"), F.col("ocr_confidence"), F.col("plate_crop_quality")), 6).alias("score"))


@query("sf31_dates", "select detection_id, cast(hour(created_at) as int) as h, cast(created_at as date) as d, strftime(created_at, '%d/%m') as dm from detections")
def dates(spark, sf):
    return T.detections(spark, sf).select("detection_id", F.hour("created_at").alias("h"), F.to_date("created_at").alias("d"), F.date_format("created_at", "dd/MM").alias("dm"))


@query("sf34_rounded", "select camera_id, round(avg(detection_confidence) * 100, 1) as c from detections group by 1")
def rounded(spark, sf):
    return T.detections(spark, sf).groupBy("camera_id").agg(F.round(F.avg("detection_confidence") * 100, 1).alias("c"))


@query("sf41_converters", "select detection_id, cast(c as double) / 10 as v from (select detection_id, cast(round(detection_confidence * 1000) as int) as c from detections)")
def converters(spark, sf):
    text = F.concat((F.round(F.col("detection_confidence") * 1000).cast("int") / 10).cast("string"), F.lit("%"))
    return T.detections(spark, sf).select("detection_id", F.round(X.to_number(text), 6).alias("v"))


@query("sf42_labels", "select detection_status, case detection_status when 1 then 'Terbaca' when 2 then 'Perlu Cek' else 'Gagal' end as label, count(*) as n from detections group by 1")
def labels(spark, sf):
    return T.detections(spark, sf).groupBy("detection_status").agg(F.count("*").alias("n")).select("detection_status", X.status_label(F.col("detection_status")).alias("label"), "n")


@query("sf43_buckets", "select case when c < 700 then 'yellow' else 'green' end as bucket, count(*) as n from e group by 1")
def buckets(spark, sf):
    """Colours of the report's cells by confidence."""
    return T.detections(spark, sf).groupBy(X.confidence_colour(F.col("detection_confidence")).alias("bucket")).agg(F.count("*").alias("n"))


@query("sf16_segments")
def segments(spark, sf):
    return T.readings(spark, sf).select("reading_id", P.segment(F.col("text")).alias("s")).select("reading_id", "s.*")


@query("sf18_translated", "select reading_id, translate(upper(text), 'BODQCILJZSGAT', '8000011125647') as digits, translate(upper(text), '8012345679', 'BOIZEASGTP') as letters from readings")
def translated(spark, sf):
    return T.readings(spark, sf).select("reading_id", P.to_digits(F.col("text")).alias("digits"), P.to_letters(F.col("text")).alias("letters"))


@query("sf19_enumerated", f""", n as (select reading_id, {NORMAL} as t from readings),
x as (select reading_id, t, p, d, translate(substr(t, 1, p), '8012345679', 'BOIZEASGTP') || translate(substr(t, p + 1, d), 'BODQCILJZSGAT', '8000011125647') || translate(substr(t, p + d + 1), '8012345679', 'BOIZEASGTP') as made
from n, (select unnest([1, 2]) as p) pp, (select unnest([1, 2, 3, 4]) as d) dd where length(t) - p - d between 0 and 3),
z as (select *, len(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, 1) <> substr(made, i, 1))) as ch from x where regexp_full_match(made, '[A-Z]{{1,2}}[0-9]{{1,4}}[A-Z]{{0,3}}')),
b as (select reading_id, arg_min(made, row(ch, p, d)) as made, min(ch) as ch from z group by 1)
select reading_id, coalesce(made, t) as text, coalesce(made <> t, false) as applied, round(cast(case when made is null then 0 else greatest(0, 1 - ch * 0.12) end as double), 6) as score from n left join b using (reading_id)""")
def enumerated(spark, sf):
    return T.readings(spark, sf).select("reading_id", P.enumerated(F.col("text")).alias("r")).select("reading_id", "r.text", "r.applied", F.round("r.score", 6).alias("score"))


@query("sf29_lighting", """, m as (select event_id, c * 0.255::double as b, cast((c * 7) % 80 as double) as s, case when c % 11 = 0 then 0.3::double else (c % 10) / 100.0::double end as g from e),
v as (select *, least(100::double, greatest(0::double, 0.65::double * greatest(0::double, 100 - abs(b - 125) * 0.75::double) + 0.35::double * least(100::double, s * 2) - g * 80)) as score from m)
select event_id as detection_id, round(score::double, 9) as score, case when g >= 0.18 then 'GLARE' when b < 45 then 'TOO DARK' when b < 72 then 'LOW LIGHT' when b > 205 then 'OVEREXPOSED' when score >= 72 then 'GOOD' else 'FAIR' end as status from v""")
def lighting(spark, sf):
    """Lighting of regions, with grey levels made up from the confidence."""
    c = F.round(F.col("detection_confidence") * 1000).cast("int")
    glare = F.when(c % 11 == 0, 0.3).otherwise((c % 10) / 100.0)
    found = X.lighting(c * 0.255, ((c * 7) % 80).cast("double"), F.lit(0.0), glare)
    return T.detections(spark, sf).select("detection_id", found.alias("l")).select("detection_id", F.round("l.score", 9).alias("score"), "l.status")


@query("sf35_file_names", "select camera_id, regexp_replace(trim(location), '[^A-Za-z0-9._-]+', '_', 'g') as name from cameras")
def file_names(spark, sf):
    return T.cameras(spark, sf).select("camera_id", X.safe_file_name(F.col("location")).alias("name"))


@query("sf37_flattened", "select camera_id, count(*) as n from detections group by 1")
def flattened(spark, sf):
    """Nested reader results, packed as JSON by camera and block of ids, flattened to rows and counted."""
    packed = T.detections(spark, sf).groupBy("camera_id", F.floor(F.col("detection_id") / 1000).alias("block")).agg(F.to_json(F.collect_list(F.struct(F.col("detection_id").cast("string").alias("text"), F.col("detection_confidence").alias("score")))).alias("raw"))
    items = packed.select("camera_id", F.explode(F.from_json("raw", "array<struct<text:string,score:double>>")).alias("item"))
    return items.filter("item.text is not null").groupBy("camera_id").agg(F.count("*").alias("n"))


@query("sf40_track_results", VOTED + f"""select track_id, case when valid then corrected else text end as text, round(confidence * (1 - 0.5 * penalty), 6) as confidence, case when regexp_matches({NORMAL}, '^[A-Z]+0*[1-9]') and regexp_extract({NORMAL}, '^([A-Z]{{1,2}})([0-9]{{1,4}})([A-Z]{{0,3}})$', 1) in {REGION} then trim(regexp_replace({NORMAL}, '^([A-Z]{{1,2}})([0-9]{{1,4}})([A-Z]{{0,3}})$', '\\1 \\2 \\3')) else text end as shown from stable""")
def track_results(spark, sf):
    """Votes as result rows: corrected text, confidence scaled by the correction's cost, display form."""
    from ..operators.votes import votes

    v = votes(T.readings(spark, sf)).withColumn("r", P.correct(F.col("text")))
    return v.select("track_id", F.when(F.col("r.valid"), F.col("r.corrected")).otherwise(F.col("text")).alias("text"), F.round(F.col("confidence") * (1 - 0.5 * F.col("r.penalty")), 6).alias("confidence"), P.display(F.col("text")).alias("shown"))
