"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Everything is a column expression, so detection is one pass over the texts without any shuffle. Patterns use possessive
quantifiers and start guards only to keep matching linear on long runs; they find the same leftmost spans as the plain forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bound, free

#: Kinds in the order that breaks ties of equal starts; the first four are the base kinds and always stay.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "pan", "tel", "iban", "ssn")
#: Stricter kinds sought inside the failed matches of a base kind, where several numbers stand in a row.
WITHIN = {"pan": "card", "tel": "phone"}

PATTERNS = {
    # \G: right after the match before, the rest of a run of address characters can start a match too.
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "pan": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "tel": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheaper test that every text with a match of the kind passes.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"-[0-9]{2}-"}
#: Score of a confirmed span before its context is read.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "pan": 0.8, "tel": 0.7, "iban": 0.8, "ssn": 0.4}
#: Words before a span that speak for or against its kind.
FOR = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "address", "server"), "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"), "iban": ("iban", "account", "bank", "konto"), "ssn": ("ssn", "social", "security", "tax id")}
AGAINST = ("order", "version", "isbn", "serial", "invoice", "sample")
#: Characters before a span that count as its context; what a word there adds or takes; the score that added kinds need.
CONTEXT, STEP, LEAST = 48, 0.2, 0.5
#: Entries of one chunk of a running sum; code points of one block of a text.
CHUNK, BLOCK = 64, 4096

SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn's check."""

    def step(acc, i):
        v = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number passes the mod-97 check: its first four characters moved last, letters as 10 to 35."""
    moved = F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), "")

    def step(acc, c):
        return F.when(c == "", acc).when(c.rlike("[0-9]"), (acc * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(moved, F.lit(0), step) == 1


def confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind in ("card", "pan"):
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind in ("phone", "tel"):
        return F.length(digits).between(9, 15)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, "[.]"), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "iban":
        return mod97(F.regexp_replace(value, " ", ""))
    return F.lit(True)


def running(values: Column, op, levels: int = 2) -> Column:
    """Per entry of an array of numbers from 0 on, ``op`` over all entries before it, 0 for the first.

    Sums within chunks, and over chunks of chunks, so that work is linear in the entries up to CHUNK^3 and little more beyond.
    """
    zero = F.lit(0)

    def level(v: Column, left: int) -> Column:
        if not left:
            return F.transform(v, lambda _, i: F.aggregate(F.slice(v, F.lit(1), i), zero, op))

        def chunked(chunks: Column) -> Column:
            totals = F.transform(chunks, lambda c: F.aggregate(c, zero, op))
            inside = lambda c, b: F.transform(c, lambda _, i: F.aggregate(F.slice(c, F.lit(1), i), b, op))
            return bound(totals, lambda t: bound(level(t, left - 1), lambda before: F.flatten(F.zip_with(chunks, before, inside))))

        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, CHUNK))
        return bound(cut, chunked)

    return F.when(F.size(values) > 0, level(values, levels)).otherwise(F.array().cast("array<int>"))


def blocks(text: Column) -> Column:
    """A text in blocks of BLOCK code points, for a place in a long text is only found by counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end``, exclusive, of a text in blocks."""
    a, b = (start / BLOCK).cast("int"), (end / BLOCK).cast("int")
    at = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    apart = F.concat(at(a).substr(start - a * BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(parts, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), at(b).substr(F.lit(1), end - b * BLOCK))
    return F.when(a == b, at(a).substr(start - a * BLOCK + 1, end - start)).otherwise(apart)


def scored(kind: str, parts: Column, start: Column) -> Column:
    near = F.lower(between(parts, F.greatest(start - CONTEXT, F.lit(0)), start))
    has = lambda words: F.when(near.rlike("|".join(words)), STEP).otherwise(0.0)
    return F.round(F.lit(SCORES[kind]) + has(FOR[WITHIN.get(kind, kind)]) - has(AGAINST), 2)


def proposed(text: Column, kind: str) -> Column:
    """Array of the matches of one kind: start, end, value, and whether they are confirmed; null if there are none."""
    pattern = PATTERNS[kind]

    def placed(x):
        """x: matches, and the pieces between them, whose lengths add up to the starts."""
        steps = F.zip_with(x["matches"], x["pieces"], lambda m, p: F.coalesce(F.length(m), F.lit(0)) + F.coalesce(F.length(p), F.lit(0)))
        whole = bound(F.slice(steps, F.lit(1), F.size(x["matches"])), lambda s: running(s, lambda a, v: a + v))

        def one(m, i, before):
            start = F.get(before, i) + F.length(F.get(x["pieces"], i))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"), confirmed(kind, m).alias("fine"))

        return bound(whole, lambda before: F.transform(x["matches"], lambda m, i: one(m, i, before)))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("pieces"))
    return bound(both, lambda x: F.when(F.size(x["matches"]) > 0, placed(x)))


def rated(parts: Column, kind: str, found: Column) -> Column:
    """The confirmed ones of the matches, with their scores; added kinds need a least score."""
    spans = F.transform(F.filter(found, lambda s: s["fine"]), lambda s: F.struct(s["start"].cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].cast("int").alias("end"), F.lit(kind).alias("kind"), scored(kind, parts, s["start"]).alias("score")))
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= LEAST)


def kind_spans(text: Column, parts: Column, kind: str) -> Column:
    """Array of the confirmed spans of one kind, and of those inside its failed matches; positions are code points, ends exclusive."""
    none = F.array().cast(f"array<{SPAN}>")
    inner = next((k for k, outer in WITHIN.items() if outer == kind), None)

    def inside(s):
        """Spans of the stricter kind inside one failed match, moved to its place in the text."""
        moved = F.transform(proposed(s["value"], inner), lambda t: F.struct((t["start"] + s["start"]).alias("start"), (t["end"] + s["start"]).alias("end"), t["value"].alias("value"), t["fine"].alias("fine")))
        return F.coalesce(rated(parts, inner, moved), none)

    def both(found):
        own = rated(parts, kind, found)
        if not inner:
            return own
        failed = F.filter(found, lambda s: ~s["fine"] & (F.length(s["value"]) > 15))
        return F.concat(own, F.flatten(F.transform(failed, inside)))

    guard = text.contains("@") if kind == "email" else text.rlike(GUARDS[kind])
    return F.coalesce(F.when(guard, bound(proposed(text, kind), both)), none)


def detect(docs: DataFrame, *, text_col: str = "text", into: str = "pii") -> DataFrame:
    """Add column ``into``: all spans of all kinds, by start, then in order of the kinds.

    The column replaces one of the same name; all others pass through unread. A null text counts as empty and has no
    spans; repeated rows each get theirs; an empty table gives an empty one. Work per text is linear in its length and in its
    matches.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = bound(blocks(text), lambda parts: F.concat(*[kind_spans(text, parts, k) for k in KINDS if k not in WITHIN]))
    return docs.withColumn(into, F.array_sort(found))


def mask(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by its kind in angle brackets."""

    def masked(x):
        """x: the spans, for each where all before it end, where the last one ends, and the text in blocks."""
        pieces = F.zip_with(x["spans"], x["before"], lambda s, at: F.when(s["start"] >= at, F.concat(between(x["parts"], at, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), between(x["parts"], x["last"], F.length(text)))

    ends = F.transform(spans, lambda s: s["end"])
    before = bound(ends, lambda e: running(e, lambda a, v: F.greatest(a, v)))
    done = bound(F.struct(spans.alias("spans"), before.alias("before"), F.array_max(ends).alias("last"), blocks(text).alias("parts")), masked)
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with all found spans masked in their texts; columns and rows stay, null texts stay null."""
    spans = free(docs, "pii_spans")
    return detect(docs, text_col=text_col, into=spans).withColumn(text_col, F.when(F.col(text_col).isNotNull(), mask(F.col(text_col), F.col(spans)))).select(*docs.columns)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts of the base kinds, digest of their spans, and all spans."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), into="pii").select("doc_id", "pii")
    n = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def pii_base_spans(spark, sf_dir: str) -> DataFrame:
    """The part of ``op2_pii`` that SQL can express: counts and digest of the base kinds."""
    return op2_pii(spark, sf_dir).drop("spans")


#: The base patterns in their plain form; places are sums of the lengths of matches and of what lies between them.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
LUHN = f"length({DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, CAST(length({DIGITS}) AS BIGINT)), lambda i: CASE WHEN i % 2 = 0 THEN ascii(substr({DIGITS}, length({DIGITS}) - i, 1)) - 48 WHEN ascii(substr({DIGITS}, length({DIGITS}) - i, 1)) > 52 THEN 2 * (ascii(substr({DIGITS}, length({DIGITS}) - i, 1)) - 48) - 9 ELSE 2 * (ascii(substr({DIGITS}, length({DIGITS}) - i, 1)) - 48) END)) % 10 = 0"
FINE = {"email": "true", "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0", "card": LUHN, "phone": f"length({DIGITS}) BETWEEN 9 AND 15"}
PII_BASE_SQL = "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), " + ", ".join(
    f"x{r} AS (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS s FROM t WHERE regexp_matches(text, '{p}')), "
    f"y{r} AS (SELECT doc_id, '{k}' AS kind, {r} AS rank, v, CAST(coalesce(list_sum(list_transform(s[1:i], lambda z: length(z))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS start FROM (SELECT doc_id, m, s, i, m[i] AS v FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM x{r})) WHERE {FINE[k]})"
    for r, (k, p) in enumerate(PLAIN.items())
) + ", a AS (" + " UNION ALL ".join(f"SELECT * FROM y{r}" for r in range(len(PLAIN))) + "), g AS (SELECT doc_id, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in PLAIN) + ", string_agg(kind || ':' || start || ':' || (start + length(v)), ',' ORDER BY start, rank) AS spans FROM a GROUP BY doc_id) SELECT doc_id, " + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in PLAIN) + ", sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN g USING (doc_id)"
