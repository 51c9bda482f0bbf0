"""Personal data by bootstrapped contextual extraction, on DataFrames only.

Base spans of four kinds (email, ip, card, phone) come from fixed patterns: the text is split by a
kind's regular expression and running sums of the lengths of gaps and matches give the positions,
all inside one projection. Possessive forms keep the scan linear in very long texts; folds that
gather a list run over CHUNK matches at a time, since each step copies what it has gathered.

The method then looks for identifiers the patterns miss. Candidates are runs of letters and
digits with at least MIN_LENGTH characters and a digit. A candidate's lexical pattern is the word
and all marks just left of it, after the candidate before, with its shape (``token = "`` + ``h16``). Seeds are
candidates inside base spans and hexadecimal runs of SEED_HEX or more characters. The
pattern-instance graph is scored in ROUNDS rounds: a pattern's confidence is the smoothed share of
its occurrences held by believed instances, an instance's belief is one minus the product of its
patterns' doubts. Patterns of confidence MIN_CONFIDENCE and MIN_SUPPORT believed instances then mark
all their occurrences as kind ``id``. Edges are pre-aggregated counts, so a pattern as frequent as
a third of all candidates is one row a task before any shuffle, and joins on patterns are joins
Spark can split.

Cases: null text is empty; base spans always stay and candidates that touch one are not added;
spans depend on the text only, so repeated rows and repeated ids are alike; a candidate at the
very start of a text has an empty context; an empty table gives no rows; other columns are ignored
by ``find`` and kept by ``redact``. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.session import Scratch, read_table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written without backtracking (same matches).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MIN_LENGTH = 6
CANDIDATE = rf"(?<![0-9A-Za-z])(?=[A-Za-z]*+[0-9])[0-9A-Za-z]{{{MIN_LENGTH},}}+"
CHUNK = 128
SEED_HEX = 32
ROUNDS = 3
SMOOTHING = 1.0
MIN_CONFIDENCE = 0.6
MIN_SUPPORT = 3


def _kept(kind: str, m: Column) -> Column:
    """Whether a match of the base pattern counts."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3) & F.forall(F.split(m, r"\."), lambda part: F.coalesce(F.substring(F.ltrim(part, F.lit("0")), 1, 4).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _chunks(values: Column) -> Column:
    """An array in pieces of CHUNK elements, one piece at least."""
    last = F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * CHUNK + 1, F.lit(CHUNK)))


def _with(value: Column, fn) -> Column:
    """fn(value), value computed once however often fn names it."""
    return F.transform(F.array(value), fn)[0]


def positions(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, left>> of the leftmost non-overlapping matches, in code points.

    left is what stands before the match, after the match before it.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string,left:string>>)")
    joined = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("value"), g.alias("left")))
    both = F.filter(joined, lambda x: x["value"].isNotNull())  # the text after the last match has none

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + x["gap"]
        span = F.struct(lo.alias("start"), (lo + x["size"]).alias("end"), x["value"].alias("value"), x["left"].alias("left"))
        return F.struct((lo + x["size"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def piece(done: Column, chunk: Column) -> Column:
        at = F.struct(F.element_at(done, -1)["at"].alias("at"), none.alias("out"))
        return F.concat(done, F.array(F.aggregate(chunk, at, step)))

    start = F.array(F.struct(F.lit(0).alias("at"), none.alias("out")))
    return _with(both, lambda b: F.flatten(F.transform(F.aggregate(_chunks(b), start, piece), lambda r: r["out"])))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> by kind as listed, then start."""
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string,left:string>>)")
    digit = text.rlike("[0-9]")
    hints = {"email": text.contains("@"), "ip": digit & text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": text.rlike(r"\+[0-9]")}

    def of(kind: str) -> Column:
        kept = F.filter(F.when(hints[kind], positions(text, PATTERNS[kind])).otherwise(none), lambda s: _kept(kind, s["value"]))
        return F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*map(of, KINDS))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _shape(value: Column) -> Column:
    """Class of a candidate: digits only, hexadecimal or mixed, with its length in steps of 8."""
    kind = F.when(value.rlike("^[0-9]+$"), "d").when(value.rlike("^[0-9a-f]+$"), "h").otherwise("m")
    return F.concat(kind, (F.floor(F.length(value) / 8) * 8).cast("string"))


def candidates(texts: DataFrame) -> DataFrame:
    """(key, start, end, pattern, instance, seed) of every identifier-like run of the texts (key, text, base)."""

    def marked(chunk: Column) -> Column:
        lo, hi = F.get(chunk, F.lit(0))["start"], F.try_element_at(chunk, F.lit(-1))["end"]
        near = F.filter("base", lambda b: (b["start"] < hi) & (lo < b["end"]))
        touched = lambda s, of: F.exists(of, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return _with(near, lambda of: F.transform(chunk, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["left"].alias("left"), touched(s, of).alias("inside"))))

    held = texts.where(F.col("text").rlike(CANDIDATE)).select("key", "base", positions(F.col("text"), CANDIDATE).alias("spans"))
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["left"].alias("left"), F.lit(False).alias("inside")))
    spans = F.when(F.size("base") > 0, F.flatten(F.transform(_chunks(F.col("spans")), marked))).otherwise(plain)
    rows = held.select("key", F.explode(spans).alias("s")).select("key", "s.*")
    value = F.lower("value")
    # read backwards, so that one step a character finds the marks and the word before them
    back, near = F.reverse("left"), r"(?s)^([^\p{L}\p{N}]*+)(\p{L}*+)"
    word = F.lower(F.reverse(F.regexp_extract(back, near, 2)))
    marks = F.regexp_replace(F.reverse(F.regexp_extract(back, near, 1)), r"\s+", " ")
    hex_seed = (F.length("value") >= SEED_HEX) & value.rlike("^[0-9a-f]+$") & value.rlike("[0-9]")
    pattern = F.concat_ws("|", word, marks, _shape(value)).alias("pattern")
    return rows.select("key", "start", "end", pattern, value.alias("instance"), (F.col("inside") | hex_seed).alias("seed"), "inside")


def trusted_patterns(found: DataFrame, work: Scratch) -> DataFrame:
    """(pattern) of the patterns that the iterative scoring trusts."""
    edges = work.write(found.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max(F.col("seed").cast("double")).alias("belief")), "edges")
    seeds = edges.groupBy("instance").agg(F.max("belief").alias("seed"))
    belief = seeds.select("instance", F.col("seed").alias("b"))
    for k in range(ROUNDS):
        scored = edges.join(belief, "instance").groupBy("pattern").agg((F.sum(F.col("n") * F.col("b")) / (F.sum("n") + SMOOTHING)).alias("confidence"), F.sum((F.col("b") >= MIN_CONFIDENCE).cast("long")).alias("support"))
        scored = work.write(scored, f"patterns{k}")
        if k + 1 < ROUNDS:
            sure = F.when((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_SUPPORT), F.col("confidence")).otherwise(0.0)
            doubt = edges.join(scored, "pattern").groupBy("instance").agg(F.max("belief").alias("seed"), F.sum(F.log(F.greatest(1 - sure, F.lit(1e-6)))).alias("log"))
            belief = doubt.select("instance", F.greatest("seed", 1 - F.exp("log")).alias("b"))
    return scored.where((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_SUPPORT)).select("pattern")


def find(docs: DataFrame, work: Scratch | None = None) -> DataFrame:
    """doc_id, key (a hash of the text), base and found: arrays of spans of each row of docs."""
    work = work or Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text"))).withColumn("key", F.struct(F.xxhash64("text").alias("h"), F.crc32("text").alias("c")))
    found = work.write(candidates(rows), "candidates")
    base = work.write(rows.select("doc_id", "key", "base"), "base")
    sure = trusted_patterns(found, work)
    more = found.where("not inside").join(sure, "pattern").groupBy("key").agg(F.sort_array(F.collect_set(F.struct(F.lit("id").alias("kind"), "start", "end"))).alias("found"))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    return base.join(more, "key", "left").withColumn("found", F.coalesce("found", none))


def redact(docs: DataFrame, work: Scratch | None = None) -> DataFrame:
    """docs with every span replaced by its kind in brackets; null text stays null, all columns as they are."""
    work = work or Scratch(docs.sparkSession, "pii")
    hits = find(docs, work).where("size(base) + size(found) > 0").select("key", F.concat("base", "found").alias("spans")).dropDuplicates(["key"])
    ordered = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(text: Column, base: Column):
        """Folds spans into the text that starts at base."""

        def one(acc: Column, s: Column) -> Column:
            keep = F.substring(text, acc["at"] - base + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], keep, mark).alias("out"))

        return one

    def piece(acc: Column, chunk: Column) -> Column:
        end = F.greatest(acc["at"], F.array_max(F.transform(chunk, lambda s: s["end"])))
        size = end - acc["at"]
        zero = F.struct(acc["at"].alias("at"), F.lit("").alias("out"))
        clean = _with(F.substring(acc["rest"], F.lit(1), size), lambda part: F.aggregate(chunk, zero, step(part, acc["at"]), lambda a: a["out"]))
        return F.struct(end.alias("at"), F.substring(acc["rest"], size + 1, F.length(acc["rest"])).alias("rest"), F.concat(acc["out"], clean).alias("out"))

    whole = F.struct(F.lit(0).alias("at"), F.col("text").alias("rest"), F.lit("").alias("out"))
    clean = _with(ordered, lambda spans: F.aggregate(_chunks(spans), whole, piece, lambda a: F.concat(a["out"], a["rest"])))
    text = F.when(F.col("pii_spans").isNull(), F.col("text")).otherwise(clean)
    key = F.struct(F.xxhash64("text").alias("h"), F.crc32("text").alias("c"))
    joined = docs.withColumn("pii_key", key).join(hits.select(F.col("key").alias("pii_key"), F.col("spans").alias("pii_spans")), "pii_key", "left")
    return joined.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    private = (F.size("base") + F.size("found") > 0).alias("has_personal_data")
    return found.select("doc_id", *map(count, KINDS), F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.concat("base", "found")).alias("spans"), private)
