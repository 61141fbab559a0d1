"""Personal data: fixed patterns, and contexts bootstrapped from what they found.

One pass over all texts finds the base spans (email, ip, card, phone) and the candidates: words that look like identifiers, and
runs of groups of digits with single spaces between them, each with the two words before it. A run ends where a base span does; its
words are candidates too, unless a base span touches them, and give way where the whole run becomes a span. Base finds are the seeds. Candidates and contexts make a graph of distinct pairs; in each round a
context's confidence in a kind is the share of its distinct candidates that are of this kind so far, and candidates met by a
context of high confidence and support join the kind. What the contexts of the last round find beside the base
becomes spans, if it has the kind's shape. The rounds run on the graph alone, whose tables are summed on the map side first and cut at
a written table each.

Null texts count as empty and have no spans; very long texts are read whole; equal rows have equal spans; a kind without seeds
adds nothing; an empty table gives an empty result; other columns are ignored. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.columns import first_ending_after, let, starts_at, sums_before
from tideline.llm.scratch import materialise

KINDS = ("email", "ip", "card", "phone")
WORD = r"[A-Za-z0-9._%+-]"
#: The contract's patterns. Possessive repeats and the look-behinds change no match: they spare the regex engine its stack
#: and a second try inside a run that cannot match.
PATTERNS = {
    "email": rf"(?:(?<!{WORD})|\G){WORD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
SHAPES = {"email": r"[^@]@[^@]", "ip": r"^[0-9]++([.:][0-9]++){3,}+[^0-9]*$", "card": r"^[^0-9]*([0-9][\x20-]?){12,19}[^0-9]*$", "phone": r"^\+?[(]?([0-9][().-]*+\x20?+[(]?+){7,15}$"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
CANDIDATE = r"(?s)^(?=[^0-9]*+(?:[0-9][^0-9]*+){4}|.*[^@]@[^@]).{6}"
#: What a text must hold for any of its words to be a candidate.
GATE = r"(?:[0-9][^0-9]*+){4}|@"
#: A group of digits that is a word, before a space and another group.
GROUP = r"(?<![^\x20\x09-\x0D])([+(]*+[0-9][0-9().-]*+)\x20(?=[(]?[0-9][0-9().-]*+(?![A-Za-z_@]))"
#: Stands for the spaces within runs; no text should hold this noncharacter, and where one does it only parts words.
JOIN = "\uffff"
SPAN = "array<struct<start:int,end:int,kind:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit doubled, its digits added."""
    n = F.length(digits)

    def add(total: Column, at: Column) -> Column:
        one = F.substring(digits, n - at, F.lit(1)).cast("int")
        two = one * 2
        return total + F.when(at % 2 == 0, one).otherwise(F.when(two > 9, two - 9).otherwise(two))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(14, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    """Valid matches of a kind: their places are sums of the lengths of what stands between and of the matches before."""
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), lambda g: F.length(g))
    pairs = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("value"))

    def spans(p: Column) -> Column:
        widths = F.transform(p, lambda x: x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0)))
        return let(sums_before(widths), lambda before: F.transform(p, lambda x, k: told(x, F.get(before, k) + x["gap"])))

    def told(x: Column, start: Column) -> Column:
        valid = x["value"].isNotNull() & _valid(kind, x["value"])
        return F.when(valid, F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), F.lit(kind).alias("kind")))

    hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
    return F.when(hint, F.filter(let(pairs, spans), lambda s: s.isNotNull())).otherwise(F.array().cast(SPAN))


def in_order(spans: Column) -> Column:
    """By start, then by kind as listed."""
    place = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _touching(start: Column, end: Column) -> Column:
    """Kind of the first base span, in their order, that shares a place with a range; null if none does."""

    def first(kind: str, order: int) -> Column:
        met = F.get(F.col(kind), first_ending_after(F.col(kind), start))
        return F.when((F.size(kind) > 0) & (met["start"] < end), F.struct(met["start"].alias("start"), F.lit(order).alias("order"), met["kind"].alias("kind")))

    return F.array_min(F.array(*[first(k, n) for n, k in enumerate(KINDS)]))["kind"]


def _bounded(at: Column) -> Column:
    """Whether a base span starts at a place, or ends before the character before it."""

    def by(kind: str) -> Column:
        spans = F.col(kind)
        hit = let(first_ending_after(spans, at - 2), lambda k: (F.get(spans, k)["end"] == at - 1) | (F.get(spans, k)["start"] == at) | (F.get(spans, k + 1)["start"] == at))
        return F.when(F.size(spans) > 0, F.coalesce(hit, F.lit(False))).otherwise(False)

    return by("email") | by("ip") | by("card") | by("phone")


def _starts(words: Column) -> Column:
    return sums_before(F.transform(words, lambda w: F.length(w) + 1))


def _parted(words: Column) -> Column:
    """Words, with runs parted where a base span starts or ends."""

    def runs(w: Column, start: Column) -> Column:
        groups = F.split(w, JOIN, -1)
        between = lambda k, begins: F.when(k == 0, "").when(_bounded(start + F.get(begins, k)), " ").otherwise(JOIN)
        return let(groups, lambda g: let(_starts(g), lambda begins: F.split(F.array_join(F.transform(g, lambda x, k: F.concat(between(k, begins), x)), ""), " ", -1)))

    return let(words, lambda w: let(_starts(w), lambda starts: F.flatten(F.transform(w, lambda x, k: F.when(F.contains(x, F.lit(JOIN)), runs(x, F.get(starts, k))).otherwise(F.array(x))))))


def find(docs: DataFrame) -> DataFrame:
    """key, doc_id, base, seen: base spans, and candidates with start, end, token, before1, before2, run (where its run starts) and kind (null if no seed)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", text.alias("text"))
    for kind in KINDS:
        held = held.withColumn(kind, kind_spans(F.col("text"), kind))
    held = held.withColumn("base", in_order(F.concat(*KINDS)))
    held = held.withColumn("joined", F.when(F.col("text").rlike(GATE), F.regexp_replace(F.translate("text", JOIN, " "), GROUP, f"$1{JOIN}")))
    split = F.split("joined", r"[\x20\x09-\x0D]", -1)
    words = F.when(F.contains("joined", F.lit(JOIN)), _parted(split)).otherwise(split)
    held = held.withColumn("words", F.when(F.col("joined").isNotNull(), words).otherwise(F.array().cast("array<string>")))
    spots = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).rlike(CANDIDATE) | F.contains(F.get("words", i), F.lit(JOIN)))
    held = held.withColumn("spots", F.when(F.size("words") > 0, spots).otherwise(F.array().cast("array<int>")))

    def word(at: Column) -> Column:
        return F.when(at >= 0, F.lower(F.translate(F.get("words", at), JOIN, " "))).otherwise("")

    def candidate(start: Column, token: Column, before1: Column, before2: Column, run: Column) -> Column:
        end = start + F.length(token)
        return F.struct(start.alias("start"), end.alias("end"), token.alias("token"), before1.alias("before1"), before2.alias("before2"), run.alias("run"), _touching(start, end).alias("kind"))

    def inner(c: Column) -> Column:
        """The words of a run, each with the words before it."""

        def told(w: Column, k: Column, words: Column, starts: Column) -> Column:
            before1 = F.when(k == 0, c["before1"]).otherwise(F.get(words, k - 1))
            before2 = F.when(k == 0, c["before2"]).when(k == 1, c["before1"]).otherwise(F.get(words, k - 2))
            return F.when(w.rlike(CANDIDATE), candidate(c["start"] + F.get(starts, k), w, before1, before2, c["start"]))

        told_all = let(F.split(c["run"], JOIN, -1), lambda words: let(_starts(words), lambda starts: F.transform(words, lambda w, k: told(w, k, words, starts))))
        return F.filter(told_all, lambda x: x.isNotNull() & x["kind"].isNull())

    def labelled(c: Column) -> Column:
        whole = F.filter(F.array(F.when(c["token"].rlike(CANDIDATE), candidate(c["start"], c["token"], c["before1"], c["before2"], c["start"]))), lambda x: x.isNotNull())
        return F.when(F.contains(c["run"], F.lit(JOIN)), F.concat(whole, inner(c))).otherwise(whole)

    def place(i: Column, start: Column) -> Column:
        run = F.get("words", i)
        return F.struct(start.alias("start"), run.alias("run"), F.translate(run, JOIN, " ").alias("token"), word(i - 1).alias("before1"), word(i - 2).alias("before2"))

    seen = let(starts_at(F.col("words"), F.col("spots")), lambda starts: F.flatten(F.transform("spots", lambda i, k: let(place(i, F.get(starts, k)), labelled))))
    none = F.array().cast("array<struct<start:int,end:int,token:string,before1:string,before2:string,run:int,kind:string>>")
    return held.select("key", "doc_id", "base", F.when(F.size("spots") > 0, seen).otherwise(none).alias("seen"))


def contexts(c: str = "c") -> Column:
    """The contexts of a candidate: the word before it, and the two words before it."""
    return F.array(F.concat(F.lit("1 "), F.col(f"{c}.before1")), F.concat_ws(" ", F.lit("2"), F.col(f"{c}.before2"), F.col(f"{c}.before1")))


def bootstrap(found: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """pattern, kind, confidence, support of the contexts that hold after the rounds."""
    rows = found.select(F.explode("seen").alias("c")).select(F.col("c.token").alias("token"), F.col("c.kind").alias("kind"), F.explode(contexts()).alias("pattern"))
    rows = rows.filter(~F.col("pattern").rlike(r"^[12] *$"))
    edges = materialise(rows.groupBy("pattern", "token").agg(F.min("kind").alias("seed")), "graph")
    total = materialise(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "patterns")
    members = materialise(edges.filter("seed is not null").groupBy("token").agg(F.min("seed").alias("kind")), "members")
    good = None
    for _ in range(rounds):
        votes = edges.join(members, "token").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("m"))
        good = votes.join(total, "pattern").filter((F.col("m") >= support) & (F.col("m") >= confidence * F.col("n"))).select("pattern", "kind", (F.col("m") / F.col("n")).alias("confidence"), F.col("m").alias("support"))
        good = materialise(good, "confident")
        met = edges.filter("seed is null").join(good, "pattern").filter(fits("token", "kind"))
        # A new member takes the kind of its surest context; ties go by name.
        new = met.groupBy("token").agg(F.max(F.struct("confidence", "support", "kind"))["kind"].alias("kind"))
        members = materialise(new.join(members, "token", "left_anti").unionByName(members), "members")
    return good


def fits(token: str, kind: str) -> Column:
    """Whether a token has the shape of a kind."""
    shape = F.lit(False)
    for k in KINDS:
        shape = F.when(F.col(kind) == k, F.col(token).rlike(SHAPES[k])).otherwise(shape)
    return shape


def scan(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 5) -> DataFrame:
    """doc_id, base, spans of each row."""
    found = materialise(find(docs), "personal")
    good = bootstrap(found, rounds, confidence, support)
    loose = found.select("key", F.explode(F.filter("seen", lambda c: c["kind"].isNull())).alias("c")).select("key", "c.start", "c.end", "c.token", "c.run", F.explode(contexts()).alias("pattern"))
    met = loose.join(good, "pattern").filter(fits("token", "kind")).groupBy("key", "run", "start", "end").agg(F.max(F.struct("confidence", "support", "kind"))["kind"].alias("kind"))
    # A run that is a span holds the spans of its words.
    longest = met.groupBy("key", "run").agg(F.max(F.when(F.col("start") == F.col("run"), F.col("end"))).alias("until"))
    met = met.join(longest, ["key", "run"]).filter((F.col("start") == F.col("run")) & (F.col("end") == F.col("until")) | (F.col("start") >= F.coalesce("until", F.lit(0))))
    added = met.groupBy("key").agg(F.collect_list(F.struct(F.col("start"), F.col("end"), F.col("kind"))).alias("added"))
    whole = found.select("key", "doc_id", "base").join(added, "key", "left")
    return whole.select("doc_id", "base", in_order(F.concat("base", F.coalesce("added", F.array().cast(SPAN)))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the personal data of every text."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
