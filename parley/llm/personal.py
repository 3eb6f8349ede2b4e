"""Personal data with DataFrame functions and Spark's own boosted trees.

Base kinds are regular expressions with checks; their spans always stay. The method adds what they miss:

1. Generators with loose patterns propose spans (candidates) of four further kinds, which may overlap:
   written-out or bracketed mail addresses, broken-up network addresses, card numbers with other
   separators, numbers that may be telephone numbers.
2. Each candidate has features of its format (digits, groups, separators, check digit, labels) and of the text
   around it (cue words, digits, neighbouring characters).
3. Gradient-boosted trees learn from the corpus itself. Positive rows are base spans of the corpus, rewritten in
   place into forms that the base patterns miss; negative rows are candidates as they stand in the
   corpus, outside base spans.
4. A fold kept from training sets a threshold for each kind, so that at most RATE of the
   kind's negative rows reach it. Candidates from there on are added; overlapping ones are one when redacted.

All base spans and all candidates of the corpus are training or held rows: trees are grown by Spark's tasks over
ROWS_A_TASK rows each, and only sums of bins come to the driver. Candidates, features and scores cover all whole texts. With
too few rows to train on, nothing is added.

Null text has no spans; empty text neither. Repeated rows are scanned each and get equal spans; a null doc_id is carried
along; extra columns are ignored by ``digest`` and kept by ``redact``. An empty table gives no rows. Patterns run in
linear time on long texts, and a text's spans are numbered without quadratic copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.secrets import redacted
from parley.llm.shared import numbered, stored, unused

# --- fixed values: base kinds in their order --------------------------------------------------------
BASE_KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# ----------------------------------------------------------------------------------------------------

#: Kinds of candidates, each beside the base kind that it is a loose form of.
ADDED_KINDS = ("mail_like", "ip_like", "card_like", "phone_like")
KINDS = BASE_KINDS + ADDED_KINDS
_OPEN, _CLOSE = r"\x20?[\[({<]\x20?", r"\x20?[\])}>]\x20?"
_AT = rf"(?:{_OPEN}(?i:at|@){_CLOSE}|\x20(?i:at)\x20|\x20@\x20?|@\x20)"
_DOT = rf"(?:{_OPEN}(?i:dot|\.){_CLOSE}|\x20(?i:dot|punkt|punto|point)\x20|\.)"
GENERATORS = {
    "mail_like": rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,6}}+",
    "ip_like": r"(?<![A-Za-z0-9])[0-9]{1,3}+(?:\x20?[\[({]?\x20?(?:\.|,|(?i:dot))\x20?[\])}]?\x20?[0-9]{1,3}+){3}+(?![A-Za-z0-9])",
    "card_like": r"(?<![A-Za-z0-9])[0-9](?:[\x20./_\xA0-]{0,3}[0-9]){12,18}+(?![A-Za-z0-9])",
    "phone_like": r"(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}+(?![A-Za-z0-9])",
}
#: What a text must hold for a pattern to be tried; these are faster to look for.
LIKELY = {
    "email": "@",
    "phone": r"\+[0-9]",
    "mail_like": rf"(?:[\[({{<]\x20?(?i:at|@)\x20?[\])}}>]|\x20(?i:at)\x20|@)\x20?[A-Za-z0-9-]++{_DOT}[A-Za-z0-9-]",
}
DIGIT = "[0-9]"
BEFORE, AFTER = 40, 20
CUES = (
    r"(?i)(?:phone|telef|tel\b|fon\b|mobil|cell|call|fax|whats|numero|num[eé]ro|nummer|contact|kontakt)",
    r"(?i)(?:e-?mail|mail|correo|courriel|write|schreib|reach|address|adress)",
    r"(?i)(?:card|karte|tarjeta|carte|visa|master|amex|credit|kredit|pay)",
    r"(?i)(?:\bip\b|host|server|address|adress|login|ssh|ping|from)",
)
#: Rows that one task holds while the trees grow.
ROWS_A_TASK = 50_000
LEAST_ROWS = 20
FOLDS = 4
RATE = 0.005
#: Negative rows of the fold that may reach a threshold besides: personal data that no base pattern labelled.
HIDDEN = 2
TREES, DEPTH, LEARNING_RATE = 20, 3, 0.3
#: Matches of a text numbered together.
GROUP = 256
SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"
SEEN = "array<struct<start:bigint,end:bigint,token:string,before:string,after:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, as the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def occurrences(text: Column, pattern: str, likely: Column) -> Column:
    """Matches (start, end, token, before, after) in code points, with the text around up to the next match.

    Lengths of matches and of the text between add up to places, group by group, so that the work
    stays close to the number of matches. Only texts that are ``likely`` to match are searched.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def part(gaps: Column) -> Column:
        return F.transform(
            hits,
            lambda hit, i: F.struct(
                F.length(F.get(gaps, i)).cast("long").alias("gap"),
                F.length(hit).cast("long").alias("size"),
                hit.alias("token"),
                F.right(F.get(gaps, i), F.lit(BEFORE)).alias("before"),
                F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("after"),
            ),
        )

    def step(seen: Column, x: Column) -> Column:
        start = seen.pos + x.gap
        end = start + x.size
        span = F.struct(start.alias("start"), end.alias("end"), x.token.alias("token"), x.before.alias("before"), x.after.alias("after"))
        return F.struct(end.alias("pos"), F.array_append(seen.out, span).cast(SEEN).alias("out"))

    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0).cast("long"), lambda t, x: t + x.gap + x.size)

    def place(groups: Column, sums: Column) -> Column:
        def inside(group: Column, i: Column) -> Column:
            ahead = F.aggregate(F.slice(sums, F.lit(1), i), F.lit(0).cast("long"), lambda t, x: t + x)
            first = F.struct(ahead.alias("pos"), F.array().cast(SEEN).alias("out"))
            return F.aggregate(group, first, step, lambda seen: seen.out)

        return F.flatten(F.transform(groups, inside))

    def grouped(parts: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / F.lit(GROUP)).cast("int"))
        return F.transform(numbers, lambda g: F.slice(parts, g * GROUP + 1, F.lit(GROUP)))

    found = bound(
        bound(bound(gaps, part), grouped),
        lambda groups: bound(F.transform(groups, total), lambda sums: place(groups, sums)),
    )
    return F.when(likely & F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(SEEN))


def likely(kind: str, text: Column, has_digit: Column) -> Column:
    return F.regexp_like(text, F.lit(LIKELY[kind])) if kind in LIKELY else has_digit


def digits(token: Column) -> Column:
    return F.regexp_replace(token, "[^0-9]", "")


def luhn(token: Column) -> Column:
    """True where the digits of a token pass the check sum of card numbers."""

    def weighed(c: Column, i: Column) -> Column:
        value = c.cast("int") * (i % 2 + 1)
        return F.when(value > 9, value - 9).otherwise(value)

    each = F.transform(F.split(F.reverse(digits(token)), ""), weighed)
    return F.aggregate(each, F.lit(0), lambda t, x: t + F.coalesce(x, F.lit(0))) % 10 == 0


def checked(kind: str, found: Column) -> Column:
    """The matches of a base kind that pass its check."""
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?+"
    checks = {
        "email": None,
        "ip": lambda s: s.token.rlike(rf"^(?:{part}\.){{3}}{part}$"),
        "card": lambda s: luhn(s.token),
        "phone": lambda s: F.length(digits(s.token)).between(9, 15),
    }
    return found if checks[kind] is None else F.filter(found, checks[kind])


def labelled(spans: Column, kind: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end"), s.token.alias("token"), s.before.alias("before"), s.after.alias("after"))
    )


def candidates(text: Column, has_digit: Column) -> Column:
    """Spans that the generators propose in a text; they may overlap."""
    parts = [
        labelled(occurrences(text, pattern, likely(kind, text, has_digit)), KINDS.index(kind))
        for kind, pattern in GENERATORS.items()
    ]
    return F.concat(*parts)


def located(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, row, base, candidates) of docs with doc_id, text and row; texts are read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("row"), text.alias("text"))
    rows, text = rows.withColumn("has_digit", F.regexp_like("text", F.lit(DIGIT))), F.col("text")
    patterns = zip(BASE_KINDS, (EMAIL, IP, CARD, PHONE))
    base = [
        labelled(checked(kind, occurrences(text, pattern, likely(kind, text, F.col("has_digit")))), i)
        for i, (kind, pattern) in enumerate(patterns)
    ]
    proposed = candidates(text, F.col("has_digit"))
    found = rows.select("doc_id", "row", F.concat(*base).alias("base"), proposed.alias("candidates"))
    return stored(found, "located", compression="zstd")


def outside_base(rows: DataFrame) -> DataFrame:
    """One row per candidate that overlaps no base span of its text.

    Base spans and candidates of a text lie in one window by start; running ends and next starts tell overlaps.
    """
    spans = rows.where(F.size("candidates") > 0).select(
        "row",
        F.inline(
            F.concat(
                F.transform("base", lambda s: F.struct(F.lit(True).alias("is_base"), s.alias("s"))),
                F.transform("candidates", lambda s: F.struct(F.lit(False).alias("is_base"), s.alias("s"))),
            )
        ),
    )
    by_start = Window.partitionBy("row").orderBy("s.start", F.desc("is_base"))
    ahead = by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the next base start is the least from here on: the same window read from the other end
    back = Window.partitionBy("row").orderBy(F.desc("s.start"), "is_base").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.max(F.when(F.col("is_base"), F.col("s.end"))).over(ahead)
    start = F.min(F.when(F.col("is_base"), F.col("s.start"))).over(back)
    return (
        spans.withColumns({"last_end": end, "next_start": start})
        .where("NOT is_base AND coalesce(last_end <= s.start, true) AND coalesce(next_start >= s.end, true)")
        .select("row", "s.*")
    )


def features() -> list[Column]:
    """Numbers that describe a candidate (kind, token, before, after)."""
    token, before, after = F.col("token"), F.col("before"), F.col("after")
    runs = F.transform(F.regexp_extract_all(token, F.lit("[0-9]+"), F.lit(0)), F.length)
    host = F.regexp_extract(token, r"([A-Za-z0-9-]+)$", 1)

    def count(text: Column, kept: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{kept}]", ""))

    def share(text: Column, kept: str) -> Column:
        return count(text, kept) / F.greatest(F.length(text), F.lit(1))

    shape = [
        *((F.col("kind") == KINDS.index(kind)) for kind in ADDED_KINDS),
        F.length(token),
        count(token, "0-9"),
        count(token, "A-Za-z"),
        F.size(runs),
        F.array_max(runs),
        F.array_min(runs),
        F.get(runs, F.lit(0)),
        F.element_at(F.concat(F.array(F.lit(0)), runs), -1),
        F.array_max(runs) == F.array_min(runs),
        *(count(token, kept) for kept in (r"\[\](){}<>", ".", "-", "/", r"\x20", ",")),
        token.rlike("^[(+]"),
        token.rlike("^[^0-9]*0"),
        token.rlike(r"(?i)\x20at\x20"),
        token.rlike(r"(?i)\x20dot\x20|[\[({<]\x20?(?:dot|\.)"),
        token.rlike(r"(?i)[\[({<]\x20?(?:at|@)"),
        token.contains("@"),
        F.length(host),
        host.rlike("^[a-z]{2,6}$"),
        F.length(F.regexp_extract(token, r"^([A-Za-z0-9._%+-]*)", 1)),
        F.when(count(token, "0-9").between(13, 19), luhn(token)),
        F.size(F.array_distinct(F.split(digits(token), ""))),
        token.rlike(r"^(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})"),
    ]
    around = [
        *(before.rlike(cue) for cue in CUES),
        share(before, "0-9"),
        share(after, "0-9"),
        share(before, r"\p{L}"),
        share(after, r"\p{L}"),
        before.rlike(r"[:#=]\x20?$"),
        before.rlike(r"[\"'<(\[]$"),
        before.rlike(r"\p{L}$"),
        before.rlike(r"\s$") | (before == ""),
        after.rlike(r"^[\s.,;!?)]") | (after == ""),
        after.rlike(r"^\x20?[%€$£]|^\x20?(?i:eur|usd|kg|km|mb|gb)\b") | before.rlike(r"[€$£]\x20?$"),
        after.rlike(r"^\n") | before.rlike(r"\n$"),
    ]
    return [F.coalesce(x.cast("double"), F.lit(-1.0)) for x in shape + around]


def vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.array(*features())))


def rewritten() -> Column:
    """Forms (kind, form) of a base span that base patterns miss."""
    token, kind, plain = F.col("token"), F.col("kind"), digits(F.col("token"))
    national = F.regexp_replace(token, r"^\+[0-9]{1,3}[\x20.-]?", "")
    rest = digits(national)

    def forms(added: str, *values: Column) -> Column:
        return F.transform(
            F.array(*values), lambda v: F.struct(F.lit(KINDS.index(added)).alias("kind"), v.alias("form"))
        )

    def mail(at: str, dot: str) -> Column:
        host = F.replace(F.substring_index(token, "@", -1), F.lit("."), F.lit(dot))
        return F.concat(F.substring_index(token, "@", 1), F.lit(at), host)

    def dotted(dot: str) -> Column:
        return F.replace(token, F.lit("."), F.lit(dot))

    def fours(mark: str) -> Column:
        return F.regexp_replace(plain, "([0-9]{4})(?=[0-9])", f"$1{mark}")

    return (
        F.when(kind == 0, forms("mail_like", mail(" at ", " dot "), mail(" (at) ", " (dot) "), mail("[at]", "[dot]"), mail(" [at] ", ".")))
        .when(kind == 1, forms("ip_like", dotted("[.]"), dotted("(.)"), dotted(" . "), dotted(" dot ")))
        .when(kind == 2, forms("card_like", fours("."), fours("/"), fours("  "), fours("_")))
        .otherwise(
            forms(
                "phone_like",
                national,
                F.regexp_replace(rest, "^([0-9]{3})([0-9]{3})", "$1.$2."),
                F.regexp_replace(rest, "^([0-9]{3})", "0$1/"),
                F.regexp_replace(rest, "^([0-9]{3})([0-9]{3})", "$1 $2 "),
                F.concat(F.lit("00"), plain),
            )
        )
    )


def planted(rows: DataFrame) -> DataFrame:
    """Candidates of the rewritten forms in the context of their base spans, with label 1 where they are the form."""
    spans = rows.where(F.size("base") > 0).select("row", F.inline("base"))
    each = spans.select("row", "start", "before", "after", F.inline(rewritten()))
    place, size = F.length("before"), F.length("form")
    texts = each.select(
        F.xxhash64("row", "start").alias("fold"),
        F.col("kind").alias("of"),
        place.alias("place"),
        (place + size).alias("last"),
        F.concat("before", "form", "after").alias("text"),
    )
    found = texts.select("fold", "of", "place", "last", F.inline(candidates(F.col("text"), F.lit(True))))
    exact = (F.col("kind") == F.col("of")) & (F.col("start") == F.col("place")) & (F.col("end") == F.col("last"))
    return found.where("start < last AND end > place").select(
        "fold", "kind", "token", "before", "after", exact.cast("double").alias("label"), F.lit(False).alias("natural")
    )


def training_rows(rows: DataFrame, natural: DataFrame) -> DataFrame:
    """Stored table (fold, kind, token, before, after, label, natural) in files of about ROWS_A_TASK rows."""
    negative = natural.select(
        F.xxhash64("row", "start").alias("fold"), "kind", "token", "before", "after",
        F.lit(0.0).alias("label"), F.lit(True).alias("natural"),
    )
    labelled = stored(planted(rows).unionByName(negative), "labelled", compression="zstd")
    tasks = labelled.count() // ROWS_A_TASK + 1
    return stored(labelled.repartition(tasks, "fold").sortWithinPartitions("fold", "kind", "token"), "training")


def with_score(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(vectors(rows))
    return scored.withColumn("score", F.round(F.get(vector_to_array("probability"), F.lit(1)), 3))


def fit(train: DataFrame) -> tuple[GBTClassificationModel, dict[int, float]] | None:
    """Boosted trees and the threshold of each kind, or None where the rows do not suffice."""
    counts = {r.label: r.n for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < LEAST_ROWS:
        return None
    held = F.pmod("fold", F.lit(FOLDS)) == 0
    learner = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=LEARNING_RATE,
        minInstancesPerNode=10, seed=1,
    )
    model = learner.fit(vectors(train.where(~held)).select("features", "label"))
    bins = (
        with_score(model, train.where(held))
        .groupBy("kind", "score")
        .agg(F.count_if(F.col("label") == 0).alias("clean"), F.count_if(F.col("label") == 1).alias("personal"))
    )
    return model, thresholds([(r.kind, r.score, r.clean, r.personal) for r in bins.collect()])


def thresholds(
    bins: list[tuple[int, float, int, int]], rate: float = RATE, hidden: int = HIDDEN
) -> dict[int, float]:
    """Least score of each kind that at most ``rate`` of its clean rows, and ``hidden`` more, reach.

    The bins are (kind, score, clean, personal).

    It lies in the middle between the lowest score of personal rows that are let in and the next score below, 0.5 at
    least. A kind without such personal rows has none.
    """
    limits = {}
    for kind in sorted({b[0] for b in bins}):
        mine = sorted((b[1:] for b in bins if b[0] == kind), reverse=True)
        allowed, clean = rate * sum(b[1] for b in mine) + hidden, 0
        lowest, below = None, 0.0
        for score, wrong, right in mine:
            clean += wrong
            if clean > allowed or score < 0.5:
                below = score
                break
            lowest = score if right else lowest
        if lowest is not None:
            limits[kind] = max(0.5, round((lowest + below) / 2, 4))
    return limits


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, spans) of docs with doc_id, text and row; spans hold base and added ones by kind and start."""
    rows = located(docs)
    natural = stored(outside_base(rows), "candidates", compression="zstd")
    fitted = fit(training_rows(rows, natural))
    base = F.array_sort(F.transform("base", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"))))
    kept = rows.select("doc_id", "row", base.alias("base"))
    if fitted is None:
        return kept.withColumn("spans", F.col("base"))
    model, limits = fitted
    limit = F.lit(2.0)
    for kind, least in limits.items():
        limit = F.when(F.col("kind") == kind, F.lit(least)).otherwise(limit)
    added = (
        with_score(model, natural)
        .where(F.col("score") >= limit)
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    )
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
    return kept.join(added, "row", "left").select("doc_id", "row", "base", spans.alias("spans"))


def listing(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end))
    return F.array_join(each, ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and spans of every document."""
    rows = scan(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")))

    def counted(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")

    return rows.select(
        "doc_id",
        *(counted(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)),
        F.sha2(listing(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listing(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[personal]") -> DataFrame:
    """The documents with personal data replaced in their texts; all columns and rows stay."""
    key, held = unused("row", docs.columns), unused("spans", docs.columns)
    kept = numbered(docs, "scanned", key)
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))))
    found = scan(kept.select("doc_id", "text", F.col(key).alias("row"))).where(F.size("spans") > 0)
    joined = kept.join(found.select(F.col("row").alias(key), by_start.alias(held)), key, "left")
    clean = F.when(F.col(held).isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col(held), mark))
    return joined.withColumn("text", clean).select(*docs.columns)
