"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Column expressions only. `base_spans` finds the pattern matches. `candidates` takes maximal runs of token characters, strips
separators, infers each run's encoding, and tests it three ways, each against structured text in that encoding (names, paths,
words), whose moments are given in ENCODINGS:

* uniformity: the chi-squared statistic against the alphabet, by its count of collisions; structured text collides more;
* runs: how often neighbouring characters change class (lower case, upper case, digit); structured text changes less;
* serial correlation: lag-one correlation of the characters' places in the alphabet; sequences and counters have much.

The three standard scores are added (Stouffer's method, with SPREAD for what they have in common) and give one p-value.
Benjamini-Hochberg then runs within each length class, so that many short, weak candidates cannot loosen the bar for others,
over p-values binned to a tenth of a decade (at most MAX_BIN bins and 32 length classes, whatever the input's size).

Every step is linear in the text and, but for sorting, in its matches: positions are running sums by blocks of BLOCK, and
overlaps are told from ranks in sorted starts and ends.

Not tested: runs of letters of one case only, which long words can't be told from at such lengths; runs of digits; and UUIDs,
which are random but are names.

Defined cases: a null or empty text has no span; a null doc_id is kept; repeated rows each get their row; an empty table
gives an empty result; columns named like the results are replaced. A random run that touches a base span is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that starts at its first possible place and is too short holds no later, longer one: so the length is in the pattern.
ACCESS, HEX = r"(AKIA[A-Z0-9]{16,})", r"([0-9a-f]{24,})"
#: A run of token characters; every encoding below needs a digit or an upper-case letter.
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[a-z+/_=-]*[A-Z0-9])([A-Za-z0-9+/_=-]{20,})"
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
#: Encodings in the order tried: form of the run without separators, alphabet (one case where the form allows only one), its
#: size, and of structured text in it the collision probability and the rate of class changes.
ENCODINGS = (
    (r"^(?=.*[0-9])(?:(?=.*[a-f])[0-9a-f]+|(?=.*[A-F])[0-9A-F]+)$", "0123456789abcdef", 16, 0.12, 0.33),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567", 32, 0.055, 0.1),
    (r"^(?=.*[0-9])(?:(?=.*[a-z])[0-9a-z]+|(?=.*[A-Z])[0-9A-Z]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", 36, 0.063, 0.1),
    (r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64, 0.05, 0.28),
)
#: Third-moment excess of structured text, spread of the sum of the three scores, and the false-discovery rate.
THIRD, SPREAD, FDR, MAX_BIN, SHORTEST = 0.0013, 1.9, 0.01, 400, 16
BLOCK = 256
SPAN = "struct<start:int,kind_no:int,end:int>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda nothing else binds a name."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def running(values: Column) -> Column:
    """Running sums of an array of ints, block by block: an array grown by one element a step would cost the square of its size."""
    nothing = F.struct(F.lit(0).alias("at"), _empty("int").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    def of(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, BLOCK))
        return _let(F.transform(blocks, lambda block: F.aggregate(block, nothing, step)), together)

    def together(sums: Column) -> Column:
        before = F.aggregate(sums, nothing, lambda acc, s: F.struct((acc["at"] + s["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(sums, before, lambda s, b: F.transform(s["out"], lambda x: x + b)))

    return F.when(F.size(values) == 0, _empty("int")).otherwise(_let(values, of))


def _spans(text: Column, pattern: str, kind: str, least: int = 1) -> Column:
    """array<struct<start,kind_no,end>> of the matches whose group has `least` characters: code points, end exclusive."""
    whole, group = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (0, 1))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("match"), group.alias("group"))
    # split gives one part more than there are matches: the text after the last
    sizes = F.transform(parts, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.coalesce(F.length(p["match"]), F.lit(0)).alias("match"), F.coalesce(F.length(p["group"]), F.lit(0)).alias("group")))

    def placed(sizes: Column) -> Column:
        ends = running(F.transform(sizes, lambda s: s["gap"] + s["match"]))
        found = F.zip_with(sizes, ends, lambda s, end: F.struct((end - s["match"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"), s["group"].alias("group")))
        kept = F.filter(found, lambda s: s["group"] >= least)
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end")))

    return F.when(text.rlike(pattern), _let(sizes, placed)).otherwise(_empty(SPAN))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, to about 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _encoding(body: Column) -> Column:
    """struct<alphabet,classes,m,kappa,change>: the encoding of a run without separators; null if none fits."""
    out = F
    for form, alphabet, m, kappa, change in ENCODINGS:
        classes = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" for c in alphabet)
        values = {"alphabet": alphabet, "classes": classes, "m": float(m), "kappa": kappa, "change": change}
        out = out.when(body.rlike(form), F.struct(*[F.lit(v).alias(k) for k, v in values.items()]))
    return out


def _battery(token: Column) -> Column:
    """struct<z,bin,stratum> of a run of token characters; null if no encoding fits."""

    def uniformity(s: Column) -> Column:
        n, kappa = s["n"], s["e"]["kappa"]
        chi = s["e"]["m"] / n * s["squares"] - n  # against the alphabet; collisions are (squares - n) of n * (n - 1)
        collisions = (chi * n / s["e"]["m"] + n * n / s["e"]["m"] - n) / (n * (n - 1))
        return (kappa - collisions) / F.sqrt((2 * kappa * (1 - kappa) + 4 * (n - 2) * THIRD) / (n * (n - 1)))

    def runs(s: Column) -> Column:
        change = s["e"]["change"]
        named = F.call_function("translate", s["own"], s["e"]["alphabet"], s["e"]["classes"])
        changes = F.length(F.regexp_replace(named, r"(.)\1*", "#")).cast("double") - 1
        return (changes - (s["n"] - 1) * change) / F.sqrt((s["n"] - 1) * change * (1 - change))

    def serial(s: Column, mean: Column) -> Column:
        value, rest = s["value"], F.size(s["value"]) - 1
        spread = F.aggregate(value, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        lagged = F.zip_with(F.slice(value, 1, rest), F.slice(value, 2, rest), lambda x, y: (x - mean) * (y - mean))
        r = F.abs(F.aggregate(lagged, F.lit(0.0), lambda a, v: a + v)) / F.greatest(spread, F.lit(1e-9)) * F.sqrt(s["n"])
        return (0.798 - r) / 0.603  # |r| of unrelated neighbours is half-normal

    def judged(s: Column) -> Column:
        z_serial = _let(F.aggregate(s["value"], F.lit(0.0), lambda a, v: a + v) / s["n"], lambda mean: serial(s, mean))
        decade = lambda z: F.floor(-F.log10(_upper_tail(F.greatest(F.lit(-8.0), F.least(z, F.lit(30.0))))) * 10)
        return _let((uniformity(s) + runs(s) + z_serial) / SPREAD, lambda z: F.struct(z.alias("z"), F.least(decade(z), F.lit(MAX_BIN)).cast("int").alias("bin"), F.floor(F.log2(s["n"])).cast("int").alias("stratum")))

    def counted(x: Column) -> Column:
        own, chars = x["own"], F.split(x["own"], "")
        counts = F.transform(F.array_distinct(chars), lambda c: F.length(own) - F.length(F.replace(own, c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c.cast("double") * c)
        value = F.transform(chars, lambda c: F.call_function("instr", x["e"]["alphabet"], c).cast("double"))
        return _let(F.struct(x["e"].alias("e"), own.alias("own"), F.length(own).cast("double").alias("n"), squares.alias("squares"), value.alias("value")), judged)

    def chosen(x: Column) -> Column:
        own = F.when(x["e"]["m"] == 64, x["body"]).otherwise(F.lower(x["body"]))
        return F.when(x["e"].isNotNull(), _let(F.struct(x["e"].alias("e"), own.alias("own")), counted))

    stripped = F.when(~token.rlike(UUID), F.regexp_replace(token, "[-_=]", ""))
    long_ones = _let(stripped, lambda body: F.struct(body.alias("body"), F.when(F.length(body) >= SHORTEST, _encoding(body)).alias("e")))
    return _let(long_ones, chosen)


def candidates(text: Column) -> Column:
    """array<struct<start,kind_no,end,test>>: the runs that have an encoding."""
    tokens = F.regexp_extract_all(text, F.lit(RUN), F.lit(1))
    tested = F.zip_with(_spans(text, RUN, "random"), tokens, lambda s, t: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"), s["end"].alias("end"), _battery(t).alias("test")))
    return F.when(text.rlike(RUN), F.filter(tested, lambda s: s["test"].isNotNull()))


def thresholds(found: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Per length class the least bin that is a discovery (Benjamini-Hochberg over the bins of `runs`): at most 32 numbers."""
    counts = found.select(F.explode("runs").alias("c")).groupBy("c.test.stratum", "c.test.bin").count()
    w = Window.partitionBy("stratum")
    ranked = counts.withColumn("at_least", F.sum("count").over(w.orderBy(F.desc("bin")))).withColumn("total", F.sum("count").over(w))
    hits = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / 10.0) <= fdr * F.col("at_least") / F.col("total"))
    return {r["stratum"]: r["bin"] for r in hits.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def base_spans(text: Column) -> Column:
    """array<struct<start,kind_no,end>> of the pattern matches by start, then kind."""
    return F.sort_array(F.concat(_spans(text, ASSIGN, "assign", least=6), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex")))


def apart(found: Column, base: Column) -> Column:
    """The spans of `found` (by start, disjoint) that overlap none of `base`: as many of base end before a span as begin before its end."""
    tag = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"))

    def before(spans: Column, base: Column, edge: str, mine: int) -> Column:
        """For each span, how many of base have their other edge before this one."""
        other = "start" if edge == "end" else "end"
        every = F.sort_array(F.concat(F.transform(base, lambda b: tag(b[other], 1 - mine)), F.transform(spans, lambda s: tag(s[edge], mine))))

        def counted(every: Column) -> Column:
            sums = running(F.transform(every, lambda e: (e["kind"] == 1 - mine).cast("int")))
            both = F.zip_with(every, sums, lambda e, n: F.struct(e["kind"].alias("kind"), n.alias("n")))
            return F.transform(F.filter(both, lambda x: x["kind"] == mine), lambda x: x["n"])

        return _let(every, counted)

    def checked(x: Column) -> Column:
        begun, ended = before(x["found"], x["base"], "end", 0), before(x["found"], x["base"], "start", 1)
        free = F.zip_with(begun, ended, lambda a, b: a == b)
        marked = F.zip_with(x["found"], free, lambda s, f: F.struct(s.alias("span"), f.alias("free")))
        return F.transform(F.filter(marked, lambda m: m["free"]), lambda m: m["span"])

    return F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(_let(F.struct(found.alias("found"), base.alias("base")), checked))


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """docs with `base` and `spans`: arrays of struct<start,kind_no,end>. The battery's spans that touch a base one are left out."""
    runs = candidates(F.col("_text"))
    least = thresholds(docs.select(text_of().alias("_text")).select(runs.alias("runs")), fdr)
    found = docs.withColumn("_text", text_of()).withColumn("base", base_spans(F.col("_text")))
    if not least:
        return found.withColumn("spans", F.col("base")).drop("_text")
    bar = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])
    hits = F.filter(runs, lambda c: c["test"]["bin"] >= F.try_element_at(bar, c["test"]["stratum"]))
    more = F.transform(hits, lambda c: F.struct(c["start"].alias("start"), c["kind_no"].alias("kind_no"), c["end"].alias("end")))
    # bound in one lambda: as columns of their own they would be computed again wherever a lambda names them
    both = F.struct(F.col("base").alias("base"), F.coalesce(more, _empty(SPAN)).alias("more"))
    spans = _let(both, lambda x: F.sort_array(F.concat(x["base"], apart(x["more"], x["base"]))))
    return found.withColumn("spans", spans).drop("_text")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by [SECRET]; overlapping spans count as one. The text is cut into chunks of BLOCK
    characters first, as reaching a place in a long text takes time."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def kept(x: Column) -> Column:
        starts, ends = F.sort_array(F.transform(x["spans"], lambda s: s["start"])), F.sort_array(F.transform(x["spans"], lambda s: s["end"]))
        gaps = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(starts, F.array(F.lit(2**31 - 1 - BLOCK))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        # nothing covers the place where as many spans have ended as have begun
        return _let(F.filter(gaps, lambda g: g["a"] <= g["b"]), lambda gaps: F.array_join(F.transform(gaps, lambda g: piece(x["chunks"], g["a"], g["b"])), "[SECRET]"))

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        some = F.slice(chunks, first + 1, F.ceil(b / BLOCK).cast("int") - first)

        def part(chunk: Column, i: Column) -> Column:
            begin = F.greatest(a - (first + i) * BLOCK, F.lit(0))
            return F.substring(chunk, begin + 1, F.least(b - (first + i) * BLOCK, F.lit(BLOCK)) - begin)

        return F.array_join(F.transform(some, part), "")

    return _let(F.struct(chunks.alias("chunks"), spans.alias("spans")), kept)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the secret spans: counts of the base kinds, a digest of the base spans, and all spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind_no"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with their own columns, every secret in text replaced; n_chars, if there is one, follows the new text."""
    found = scan(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    hit = F.size("spans") > 0
    row = F.col("row").withField("text", F.when(hit, redact(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(hit, F.length(row["text"]).cast("long")).otherwise(F.col("row.n_chars")))
    return found.select(row.alias("row")).select("row.*")
