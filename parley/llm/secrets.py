"""Secret scans with DataFrame functions only.

Base kinds are regular expressions. The method adds tokens that look drawn at random. A candidate is a run
of at least LEAST characters of the base-64 alphabets; its encoding is inferred from the characters used. Three tests
against uniform draws are made: chi-squared over the encoding's alphabet, runs below and above the
middle of it, and correlation of neighbours. Runs and correlation must not speak against randomness.
The chi-squared value gives the probability that ordinary text, whose letters are uneven, would look
so even; short text often does, so this is a test of its own for each class of lengths, and the
Benjamini-Hochberg rule over all candidates of a class sets the threshold.

Null text has no spans; empty text neither. Repeated rows are scanned each; a null doc_id is carried
along; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.shared import numbered, stored, unused

# --- fixed values: base patterns; the second group of assign has 12 or more characters -----------
ASSIGN = (
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_VALUE = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}+"
KINDS = ("assign", "access", "hex", "random")
# ------------------------------------------------------------------------------------------------

LEAST = 20
#: An equals sign may stand before a token; behind it, it is padding only where no token goes on.
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}+(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?"
LENGTHS = (32, 48, 96)
RATE = 0.01
GUARD = 3.0
#: Sums of squared and cubed letter shares of ordinary text, and of ordinary runs of hex digits: words of
#: the six letters or numbers, each about even.
TEXT_SQUARES, TEXT_CUBES = 0.065, 0.0055
HEX_SQUARES, HEX_CUBES = 0.17, 0.033
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    (r"^[0-9]+$", ""),
    (r"^[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", UPPER + "234567"),
    (r"^[a-z]+$", LOWER),
    (r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    (r"", UPPER + LOWER + DIGITS + "+/"),
)
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
SEEN = "array<struct<start:bigint,end:bigint,token:string>>"


def find(text: Column, pattern: str, keep=None) -> Column:
    """Spans (start, end, token) of kept matches, in code points.

    The text between matches comes from a split by the same pattern; lengths add up to places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

    def step(seen: Column, part: Column) -> Column:
        start = seen.pos + F.length(part.gap)
        end = start + F.coalesce(F.length(part.hit), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), part.hit.alias("token"))
        wanted = part.hit.isNotNull() if keep is None else F.coalesce(keep(part.hit), F.lit(False))
        grown = F.when(wanted, F.array_append(seen.out, span)).otherwise(seen.out)
        return F.struct(end.alias("pos"), grown.cast(SEEN).alias("out"))

    empty = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(SEEN).alias("out"))
    found = F.aggregate(parts, empty, step, lambda seen: seen.out)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(SEEN))


def long_value(hit: Column) -> Column:
    return F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_VALUE


def upper_tail(z: Column) -> Column:
    """Close bound of the normal distribution's upper tail."""
    tail = 0.5 * F.exp(-0.717 * F.abs(z) - 0.416 * z * z)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def inferred(token: Column) -> Column:
    """Alphabet of a token; empty for plain numbers, which are not judged."""
    last = len(ENCODINGS) - 1
    out = F.lit(ENCODINGS[last][1])
    for pattern, alphabet in reversed(ENCODINGS[:last]):
        out = F.when(F.regexp_like(token, F.lit(pattern)), F.lit(alphabet)).otherwise(out)
    return out


def battery(rows: DataFrame) -> DataFrame:
    """Adds p and whether runs and neighbours allow randomness to rows with a token."""
    squares = F.aggregate(
        F.split("alphabet", ""),
        F.lit(0.0),
        lambda total, c: total
        + F.pow(F.col("n") - F.length(F.replace(F.col("plain"), c, F.lit(""))), F.lit(2)),
    )
    codes = F.transform(F.split("plain", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double"))
    spread = F.aggregate("codes", F.lit(0.0), lambda t, x: t + F.pow(x - F.col("mean"), F.lit(2)))
    pairs = F.zip_with(
        F.slice("codes", F.lit(1), F.greatest(F.size("codes") - 1, F.lit(0))),
        F.slice("codes", F.lit(2), F.greatest(F.size("codes") - 1, F.lit(0))),
        lambda a, b: (a - F.col("mean")) * (b - F.col("mean")),
    )
    ones = F.length(F.replace(F.col("sides"), F.lit("0"), F.lit("")))
    runs = F.length(F.regexp_replace(F.regexp_replace("sides", "0+", "0"), "1+", "1"))
    judged = (
        rows.withColumn("plain", F.translate(F.rtrim(F.col("token"), F.lit("=")), "-_", "+/"))
        .withColumn("alphabet", inferred(F.col("plain")))
        .where("alphabet <> ''")
        .withColumns({"n": F.length("plain").cast("double"), "k": F.length("alphabet").cast("double")})
        .withColumns({"chi": F.col("k") * squares / F.col("n") - F.col("n"), "codes": codes})
        .withColumn("sides", F.expr(r"translate(plain, alphabet, concat(repeat('0', int(k / 2)), repeat('1', int(ceil(k / 2)))))"))
        .withColumn("mean", F.aggregate("codes", F.lit(0.0), lambda t, x: t + x) / F.col("n"))
        .withColumns({"ones": ones, "runs": runs, "spread": spread})
        .withColumn("zeros", F.col("n") - F.col("ones"))
        .withColumn("expected", 2 * F.col("ones") * F.col("zeros") / F.col("n"))
        .withColumn(
            "z_runs",
            (F.col("runs") - 1 - F.col("expected"))
            / F.sqrt(F.greatest(F.col("expected") * (F.col("expected") - 1) / (F.col("n") - 1), F.lit(0.01))),
        )
        .withColumn(
            "z_serial",
            F.aggregate(pairs, F.lit(0.0), lambda t, x: t + x)
            / F.greatest(F.col("spread"), F.lit(1e-9))
            * F.sqrt("n"),
        )
    )
    is_hex = F.col("k") == 16
    squares_of_text = F.when(is_hex, HEX_SQUARES).otherwise(TEXT_SQUARES)
    excess = F.when(is_hex, HEX_CUBES - HEX_SQUARES**2).otherwise(TEXT_CUBES - TEXT_SQUARES**2)
    text_chi = F.col("k") * (1 + (F.col("n") - 1) * squares_of_text) - F.col("n")
    text_sd = F.sqrt(
        2 * (F.col("k") - 1)
        + 4 * F.col("n") * F.col("k") ** 2 * excess
    )
    length_class = sum((F.col("n") >= x).cast("int") for x in LENGTHS)
    return judged.select(
        *rows.columns,
        F.round(upper_tail((text_chi - F.col("chi")) / text_sd), 12).alias("p"),
        ((F.abs("z_runs") <= GUARD) & (F.abs("z_serial") <= GUARD)).alias("even"),
        length_class.alias("class"),
    )


def thresholds(judged: DataFrame, rate: float = RATE) -> dict[int, float]:
    """Largest p of each length class that the false-discovery rule lets pass.

    p is counted in bins of a tenth of its power of ten; a few hundred bins come to the driver.
    """
    steps = F.floor(-10 * F.log10(F.greatest("p", F.lit(1e-30))))
    bins = judged.groupBy("class", steps.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    least = Window.partitionBy("class").orderBy(F.desc("bin"))
    rows = bins.select(
        "class",
        F.pow(F.lit(10.0), -F.col("bin") / 10).alias("p"),
        F.sum("n").over(least).alias("found"),
        F.sum("n").over(Window.partitionBy("class")).alias("m"),
    )
    passing = rows.where(F.col("p") <= rate * F.col("found") / F.col("m"))
    return {r["class"]: r.p for r in passing.groupBy("class").agg(F.max("p").alias("p")).collect()}


def located(docs: DataFrame) -> DataFrame:
    """Stored rows (doc_id, row, base spans, candidates) of docs with a number _row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("_row").alias("row"), text.alias("text"))
    found = rows.select(
        "doc_id",
        "row",
        find(F.col("text"), ASSIGN, long_value).alias("assign"),
        find(F.col("text"), ACCESS).alias("access"),
        find(F.col("text"), HEX).alias("hex"),
        find(F.col("text"), CANDIDATE).alias("candidates"),
    )
    base = F.concat(*(labelled(F.col(k), i) for i, k in enumerate(KINDS[:3])))
    return stored(found.select("doc_id", "row", F.array_sort(base).alias("base"), "candidates"), "located")


def labelled(spans: Column, kind: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s.start.alias("start"), F.lit(kind).alias("kind"), s.end.alias("end")),
    )


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, row, base, spans) of every row of docs; spans hold base and added ones in order.

    docs holds doc_id, text and the number _row of each row; texts are read once.
    """
    rows = located(docs)
    candidates = rows.where(F.size("candidates") > 0).select("row", "base", F.explode("candidates").alias("c"))
    covered = F.exists("base", lambda b: (b.start <= F.col("c.start")) & (F.col("c.end") <= b.end))
    candidates = candidates.where(~covered).select("row", "c.start", "c.end", "c.token")
    judged = stored(battery(candidates), "judged")
    limits = thresholds(judged, rate)
    limit = F.lit(-1.0)
    for length_class, p in limits.items():
        limit = F.when(F.col("class") == length_class, F.lit(p)).otherwise(limit)
    added = (
        judged.where(F.col("even") & (F.col("p") <= limit))
        .groupBy("row")
        .agg(
            F.collect_list(
                F.struct("start", F.lit(KINDS.index("random")).alias("kind"), "end")
            ).alias("added")
        )
    )
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
    return rows.join(added, "row", "left").select("doc_id", "row", "base", spans.alias("spans"))


def listing(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end))
    return F.array_join(each, ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every document."""
    rows = scan(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row")))

    def counted(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")

    return rows.select(
        "doc_id",
        *(counted(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(listing(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listing(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """Text with sorted spans, overlapping ones as one, replaced by a mark."""
    chars = F.split(text, "")

    def step(done: Column, span: Column) -> Column:
        begin = F.greatest(done.pos, span.start)
        clear = F.array_join(F.slice(chars, (done.pos + 1).cast("int"), (begin - done.pos).cast("int")), "")
        fresh = F.when(span.start >= done.pos, F.concat(done.out, F.array(clear, F.lit(mark)))).otherwise(done.out)
        return F.struct(F.greatest(done.pos, span.end).alias("pos"), fresh.alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out"))

    def rest(done: Column) -> Column:
        left = F.slice(chars, (done.pos + 1).cast("int"), F.greatest(F.size(chars) - done.pos, F.lit(0)).cast("int"))
        return F.concat(F.array_join(done.out, ""), F.array_join(left, ""))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with secrets replaced in their texts; all columns and rows stay."""
    key, held = unused("row", docs.columns), unused("spans", docs.columns)
    kept = numbered(docs, "scanned", key)
    found = scan(kept.select("doc_id", "text", F.col(key).alias("_row"))).where(F.size("spans") > 0)
    joined = kept.join(found.select(F.col("row").alias(key), F.col("spans").alias(held)), key, "left")
    clean = F.when(F.col(held).isNull(), F.col("text")).otherwise(
        redacted(F.col("text"), F.col(held), mark)
    )
    return joined.withColumn("text", clean).select(*docs.columns)
