"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base entities (email, ip, card, phone) are found by patterns and checks and are the seeds. Around each seed two
lexical patterns are induced: the two words before it, and the word before with the word after. What looks like an
identifier and has no base entity in it is a candidate with the same patterns: a form of e-mail or IPv6 address, a run
of number groups with blanks, or another token (runs and tokens: ``LEAST`` characters, ``DIGITS`` digits).
Patterns and instances form a graph that is scored in ``ROUNDS`` rounds: a pattern's confidence is the score of its
distinct instances of its kind over the number of all plus one, a candidate's score is one minus the product of what
its patterns leave, its kind that of the most confident one. A pattern takes part from ``SUPPORT`` distinct instances of
one kind on, seeds and candidates with a score of ``CONFIDENCE`` from the rounds before, so each round can go one step
further. Patterns with ``CONFIDENCE`` name the candidates they reach, with the pattern's kind. Graph rows are a few words for each identifier; texts stay where they are read.

Quantifiers are possessive where that changes nothing, so no text makes the regex engine recurse or go back far.

Cases: a null text is an empty one; rows equal in doc_id and text get the same spans; of several kinds that patterns give
a place the most confident one's counts, ties going to the first in the order email, ip, card, phone; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicegate.llm.common import discard, documents, materialise, row_key
from sluicegate.llm.line_dedup import SPACE
from sluicegate.llm.quality_rules import let

#: Kinds in order, with patterns that give the matches of the plain forms.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{14,}", "phone": r"\+[0-9]"}
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Characters and digits of an identifier-like token.
LEAST, DIGITS = 6, 3
TOKEN = rf"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]{{{LEAST}}})(?:[^\x20\x09-\x0D0-9]*+[0-9]){{{DIGITS}}}[^\x20\x09-\x0D]*+"
#: Candidates of other forms: addresses with or without a dot, brackets around "at" and "dot"; IPv6; number groups.
_NAME, _OPEN, _CLOSE = r"[^\x20\x09-\x0D@()\[\]{}<>,;:\"]", r"\x20?[(\[{]", r"[)\]}]\x20?"
ADDRESS = rf"(?<!{_NAME}){_NAME}++(?:@|{_OPEN}(?i:at){_CLOSE})[^\x20\x09-\x0D@()\[\]{{}}<>,;:\"!?.]++(?:(?:\.|{_OPEN}(?i:dot){_CLOSE})[^\x20\x09-\x0D@()\[\]{{}}<>,;:\"!?.]++)*+"
COLONS = r"(?<![0-9A-Za-z:.])(?=:*+[0-9A-Fa-f])(?:[0-9A-Fa-f]{0,4}+:){2,7}+[0-9A-Fa-f]{0,4}+(?![0-9A-Za-z:])"
_GROUP = r"\(?[0-9]++(?:[()./+-]++[0-9]++)*+\)?(?![^\x20\x09-\x0D.,;:!?)\]\"'])"
GROUPS = rf"(?<=^|[\x20\x09-\x0D]|^[(\[\"']|[\x20\x09-\x0D][(\[\"'])(?=\(?[0-9])(?=[0-9()./+\x20-]{{{LEAST}}})(?=(?:[()./+\x20-]*+[0-9]){{{DIGITS}}}){_GROUP}(?:\x20(?:[/-]\x20)?{_GROUP})++"
ROUNDS, SUPPORT, CONFIDENCE = 3, 3, 0.8
PUNCTUATION = "!\"#$%&'()*,.:;<=>?[]^_`{|}~/\\-+"
SPAN = "array<struct<kind:int,start:int,end:int,text:string,before:string,left:string,right:string>>"


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _words(piece: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.translate(piece, SPACE + PUNCTUATION, " " * (len(SPACE) + len(PUNCTUATION)))), " {2,}+", " "))


def located(text: Column, pattern: str, kind: int) -> Column:
    """The matches with start and end in code points and the words next to them."""

    def step(z: Column, acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(z["gaps"], i))
        found = F.get(z["found"], i)
        end = start + F.length(found)
        before, after = F.get(z["words"], i), F.get(z["words"], i + 1)
        row = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), found.alias("text"), F.substring_index(before, " ", -2).alias("before"), F.substring_index(before, " ", -1).alias("left"), F.substring_index(after, " ", 1).alias("right"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    both = let(F.split(text, pattern, -1), lambda gaps: F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), gaps.alias("gaps"), F.transform(gaps, _words).alias("words")))
    init = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return let(both, lambda z: F.when(F.size(z["found"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(z["found"]) - 1), init, lambda acc, i: step(z, acc, i))["out"]).otherwise(F.array().cast(SPAN)))


def base_spans(text: Column) -> Column:
    """All base entities of a text, kind after kind, each by start."""
    digits = lambda s: F.translate(s["text"], " ()+.-", "")
    checks = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: s["text"].rlike(f"^{BYTE}\\.{BYTE}\\.{BYTE}\\.{BYTE}$"),
        "card": lambda s: F.when(F.length(digits(s)).between(16, 19), luhn(digits(s))).otherwise(False),
        "phone": lambda s: F.length(digits(s)).between(8, 15),
    }
    none = F.array().cast(SPAN)
    return F.concat(*[F.when(text.contains("@") if kind == "email" else text.rlike(HINTS[kind]), F.filter(located(text, KINDS[kind], k), checks[kind])).otherwise(none) for k, kind in enumerate(KINDS)])


def identifier_spans(text: Column, spans: Column) -> Column:
    """What looks like an identifier and touches no base entity, and no candidate of a form before it."""
    none = F.array().cast(SPAN)

    def free(hint: Column, pattern: str, taken: Column) -> Column:
        return F.when(hint, F.filter(located(text, pattern, -1), lambda s: ~F.exists(taken, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))).otherwise(none)

    forms = [(text.rlike(r"@|(?i:[(\[{]at[)\]}])"), ADDRESS), (text.rlike(":[0-9A-Fa-f]*:"), COLONS), (text.rlike(r"[0-9]\)?\x20(?:[/-]\x20)?\(?[0-9]"), GROUPS), (text.rlike("[0-9]"), TOKEN)]

    def after(found: Column, k: int) -> Column:
        return found if k == len(forms) else let(F.concat(found, free(*forms[k], F.concat(spans, found))), lambda more: after(more, k + 1))

    return after(none, 0)


def edges(table: DataFrame) -> DataFrame:
    """Pattern-instance pairs: pattern and instance hashes, kind (-1: candidate), document key and place."""
    rows = table.select("_k1", "_k2", F.explode(F.concat("spans", "tokens")).alias("s")).select("_k1", "_k2", "s.*")
    two = F.when(F.col("before").contains(" "), F.concat(F.lit("L "), F.col("before")))
    both = F.when((F.col("left") != "") & (F.col("right") != ""), F.concat(F.lit("B "), F.col("left"), F.lit(" "), F.col("right")))
    return (
        rows.withColumn("p", F.explode(F.array(two, both)))
        .where("p IS NOT NULL")
        .select("_k1", "_k2", "kind", "start", "end", F.xxhash64("p").alias("pattern"), F.xxhash64("text").alias("instance"))
    )


def discover(table: DataFrame) -> DataFrame:
    """_k1, _k2, kind, start, end of the candidates that confident patterns reach."""
    graph = materialise(edges(table), "pii-graph")
    pairs = graph.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    kinds = range(len(KINDS))
    seeds = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("kind") == k).cast("long")).alias(f"s{k}") for k in kinds])
    # patterns with fewer instances than the support can never get it; the others and their candidates are scored
    patterns = materialise(seeds.where(F.col("n") >= SUPPORT), "pii-patterns")
    links = materialise(pairs.where("kind = -1").select("pattern", "instance").join(patterns.select("pattern"), "pattern"), "pii-links")
    scores, done = None, [graph, patterns, links]
    for r in range(ROUNDS):
        if scores is None:
            known = patterns.select("*", *[F.lit(0).alias(f"a{k}") for k in kinds], *[F.lit(0.0).alias(f"m{k}") for k in kinds])
        else:
            own = [(F.col("as") == k, k) for k in kinds]
            got = links.join(scores, "instance").groupBy("pattern").agg(*[F.sum((mine & (F.col("score") >= CONFIDENCE)).cast("long")).alias(f"a{k}") for mine, k in own], *[F.sum(F.when(mine, F.col("score")).otherwise(0.0)).alias(f"m{k}") for mine, k in own])
            known = patterns.join(got, "pattern", "left").na.fill(0)
        support = [F.col(f"s{k}") + F.col(f"a{k}") for k in kinds]
        most = F.greatest(*support)
        first = lambda values: F.coalesce(*[F.when(x == most, v) for x, v in zip(support, values, strict=True)])
        confidence = known.where(most >= SUPPORT).select("pattern", first([F.lit(k) for k in kinds]).alias("of"), (first([F.col(f"s{k}") + F.col(f"m{k}") for k in kinds]) / (F.col("n") + 1)).alias("confidence"))
        confidence = materialise(confidence, f"pii-confidence{r}")
        scored = links.join(confidence, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"), F.min(F.struct(-F.col("confidence"), "of"))["of"].alias("as"))
        scores = materialise(scored, f"pii-scores{r}")
        done += [confidence, scores]
    reached = graph.where("kind = -1").join(confidence.where(F.col("confidence") >= CONFIDENCE), "pattern").join(scores.where(F.col("score") >= CONFIDENCE), "instance")
    found = materialise(reached.groupBy("_k1", "_k2", "start", "end").agg(F.min_by("of", F.struct(-F.col("confidence"), "of")).alias("kind")), "pii-found")
    discard(*done)
    return found


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _named(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base (kind:start:end of the base spans), spans (of all spans)."""
    text = F.coalesce("text", F.lit(""))
    staged = docs.select("doc_id", *row_key("doc_id", "text"), text.alias("text")).withColumn("spans", base_spans(F.col("text")))
    table = materialise(staged.withColumn("tokens", identifier_spans(F.col("text"), F.col("spans"))).drop("text"), "pii-spans")
    found = discover(table.where((F.size("spans") > 0) | (F.size("tokens") > 0))).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    joined = table.select("doc_id", "_k1", "_k2", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("own")).join(found, ["_k1", "_k2"], "left")
    everything = F.array_sort(F.concat("own", F.coalesce("more", F.filter("own", lambda s: F.lit(False)))))
    counts = [_count(F.col("own"), k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return joined.select("doc_id", *counts, _named(F.col("own")).alias("base"), _named(everything).alias("spans"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
