"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust a score.

Built-in column functions only. For each kind, `split(text, pattern)` gives the gaps and `regexp_extract_all` the
matches of the same scan, so the running length of gaps and matches is the position of every span in code points.

Kinds: email, ip, card (Luhn), phone, and two that the checks add: iban (ISO 7064 mod 97) and key (access keys and
assigned passwords). Base kinds always stay; added spans stay if their score reaches `MIN_SCORE`.

Defined results: a null text counts as empty (no spans); null doc_id and repeated rows give a row each; other columns of
the input are not read. Patterns are possessive and begin at the start of a run, so that long runs cost linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Kinds in the order that breaks ties between spans with one start.
KINDS = ("email", "ip", "card", "phone", "iban", "key")

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?:password|passwd|secret|api_key|token)=[^\x20\x09-\x0D]++)",
}
#: Cheap conditions that a text with a match must meet; None: no cheaper one than the pattern itself.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "key": None}

#: Words near a span that raise or lower its score.
CONTEXT = {
    "email": r"mail|e-mail|contact|write",
    "ip": r"address|host|server|ip",
    "card": r"card|visa|credit|pay|karte|tarjeta|carte",
    "phone": r"phone|call|tel|fax|mobile",
    "iban": r"iban|bank|account|konto|cuenta|compte",
    "key": r"key|secret|login|user|aws|access",
}
AGAINST = r"version|order|invoice|isbn|serial|example"
BASE_SCORE = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.8, "key": 0.7}
NEAR = 40
#: Characters of a block of text in which a span's neighbourhood is looked up, and matches of a run.
BLOCK, RUN = 1024, 64
MIN_SCORE = 0.5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn sum."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        twice = d * 2
        return s + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an account number has remainder 1 by 97, its first four characters moved to the end."""
    flat = F.regexp_replace(iban, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))

    def add(r: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (r * 100 + c - 55) % 97).otherwise((r * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})){3}$")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 12) & (n <= 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(text: Column) -> Column:
    """The text in parts of BLOCK characters."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _around(blocks: Column, start: Column, end: Column) -> Column:
    """The NEAR characters before and after a span, from the blocks that hold them: the cost does not grow with the place in the text."""

    def part(a: Column, b: Column) -> Column:
        k = F.floor(a / BLOCK).cast("int")
        two = F.concat(F.coalesce(F.get(blocks, k), F.lit("")), F.coalesce(F.get(blocks, k + 1), F.lit("")))
        return F.substring(two, a - k * BLOCK + 1, b - a)

    first = F.greatest(start - NEAR, F.lit(0))
    return F.lower(F.concat(part(first, start), F.lit(" "), part(end, end + NEAR)))


def _spans(kind: str, text: Column) -> Column:
    """Array of the valid spans of one kind: start, end, rank of the kind, kind, score.

    Gaps and matches are summed up to positions in runs of RUN matches, then from run to run, so that a text of many matches does not
    copy its list of spans once per match.
    """
    pattern = F.lit(PATTERNS[kind])
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
    rank = KINDS.index(kind)
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def span(blocks: Column, start: Column, hit: Column) -> Column:
        end = start + F.length(hit)
        around = _around(blocks, start, end)
        score = F.lit(BASE_SCORE[kind]) + F.when(around.rlike(rf"\b(?:{CONTEXT[kind]})\b"), 0.1).otherwise(0.0) - F.when(around.rlike(rf"\b(?:{AGAINST})\b"), 0.3).otherwise(0.0)
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), F.round(score, 3).alias("score"))

    def of_run(blocks: Column, run: Column, at: Column) -> Column:
        def add(s: Column, x: Column) -> Column:
            start = s["at"] + F.length(x["gap"])
            held = F.when(x["hit"].isNull(), False).otherwise(_valid(kind, x["hit"]))
            got = F.when(held, F.concat(s["got"], F.array(span(blocks, start, x["hit"])))).otherwise(s["got"])
            return F.struct((s["at"] + size(x)).alias("at"), got.alias("got"))

        return F.aggregate(run, F.struct(at.alias("at"), empty.alias("got")), add)["got"]

    def of_runs(v: Column) -> Column:
        total = lambda run: F.aggregate(run, F.lit(0), lambda t, x: t + size(x))
        ends = F.aggregate(F.transform(v["runs"], total), F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t)))
        return _let(F.struct(v["runs"].alias("runs"), v["blocks"].alias("blocks"), ends.alias("ends")), lambda w: F.flatten(F.transform(w["runs"], lambda run, k: of_run(w["blocks"], run, F.get(w["ends"], k)))))

    def cut(pairs: Column) -> Column:
        n = F.floor((F.size(pairs) - 1) / RUN).cast("int")
        runs = F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(pairs, k * RUN + 1, F.lit(RUN)))
        return _let(F.struct(runs.alias("runs"), _blocks(text).alias("blocks")), of_runs)

    found = _let(pairs, cut)
    need = text.rlike(PATTERNS[kind])
    if NEEDS[kind] is not None:
        need = text.contains(NEEDS[kind]) & need
    if kind in ("iban", "key"):
        found = F.filter(found, lambda x: x["score"] >= MIN_SCORE)
    return F.when(need, found).otherwise(empty)


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, spans: array of (start, rank, end, kind, score), in code points, by start and kind."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    each = [_spans(kind, F.col("_t")) for kind in KINDS]
    return base.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and the text with each span replaced by its kind in brackets; overlapping spans give one bracket."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    spans = F.array_sort(F.concat(*[_spans(kind, F.col("_t")) for kind in KINDS]))

    # spans as they are shown: one that begins inside what is hidden already adds its end only
    def hide(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        inside = (F.size(a) > 0) & (x["start"] < F.try_element_at(a, F.lit(-1))["end"])
        piece = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when(inside, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(wider))).otherwise(F.concat(a, F.array(piece)))

    hidden = F.aggregate(spans, F.array().cast("array<struct<start:int,end:int,kind:string>>"), hide)

    def shown(v: Column) -> Column:
        cut = lambda a, b: F.array_join(F.slice(v["chars"], a + 1, b - a), "")
        end_before = lambda k: F.when(k > 0, F.get(v["hidden"], k - 1)["end"]).otherwise(0)
        parts = F.transform(v["hidden"], lambda x, k: F.concat(cut(end_before(k), x["start"]), F.lit("["), x["kind"], F.lit("]")))
        return F.concat(F.array_join(parts, ""), cut(end_before(F.size(v["hidden"])), F.size(v["chars"])))

    chars = F.regexp_extract_all(F.col("_t"), F.lit("(?s)."), F.lit(0))
    text = F.when(F.size(spans) == 0, F.col("_t")).otherwise(_let(F.struct(hidden.alias("hidden"), chars.alias("chars")), shown))
    return base.select("doc_id", text.alias("text"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["rank"] < 4)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
