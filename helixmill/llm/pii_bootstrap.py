"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Base spans come from fixed patterns of four kinds. They seed a graph: every candidate (a run that looks like a
number or an address) is an instance, and the words beside it together with its shape are its lexical patterns.
A pattern's score for a kind is the mean score of its different instances, seeds counting 1; an unknown instance
takes the best score of the patterns that hold enough seeds. After a few rounds the instances of high-confidence
patterns are added as spans of that kind, wherever they occur and overlap no base span.

Null texts count as empty: no spans. Repeated rows have the same spans each. Positions are code points, end
exclusive. Ties between kinds go to the later name. Empty tables give empty ones. Neighbouring words are looked for in
``CONTEXT`` code points on each side. Instances and patterns are summed before they meet, so a frequent word or a text copied
many times is one instance; the joins are on written tables without texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, carried, restored

KINDS = ("email", "ip", "card", "phone")
#: Loops are possessive, and matches begin where a run or the last match ends, so that long runs cost no stack and no
#: quadratic time; the matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap sign that a text may hold the kind.
SIGN = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
CANDIDATE = r"(?<![0-9])\+?[0-9(][0-9().\x20-]{5,}[0-9](?![0-9])|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+|(?:\x20at\x20|\x20?\(at\)\x20?)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)"
ROUNDS = 3
SEEDS = 3
CONFIDENT = 0.9
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


PLACES = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
#: Matches are gathered in blocks of so many, as an array grows by copying.
BLOCK = 128
#: Code points before and after a match in which its neighbouring words are looked for.
CONTEXT = 64


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: what a lambda takes from outside is worked out for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def located(text: Column, pattern: str, kept: Callable[[Column], Column]) -> Column:
    """array<struct<start, end, value, before, after>> of those leftmost non-overlapping matches whose value is ``kept``.

    Places are code points: the lengths of the gaps and the matches are added up, within each block of matches from what the
    blocks before it sum to, so time grows with the matches."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    empty = F.array().cast(PLACES)

    def rows(z: Column) -> Column:
        after = F.slice(z["gaps"], F.lit(2), F.size(z["found"]))
        one = F.zip_with(z["found"], F.slice(z["gaps"], F.lit(1), F.size(z["found"])), lambda m, g: F.struct(m.alias("value"), F.char_length(g).alias("gap"), F.char_length(m).alias("size"), F.right(g, F.lit(CONTEXT)).alias("before"), kept(m).alias("kept")))
        return F.zip_with(one, after, lambda x, g: F.struct(x["value"], x["gap"], x["size"], x["before"], x["kept"], F.substring(g, 1, CONTEXT).alias("after")))

    def blocks(all_rows: Column) -> Column:
        count = F.ceil(F.size(all_rows) / F.lit(BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(all_rows, b * BLOCK + 1, F.lit(BLOCK)))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        place = F.struct(at.alias("start"), (at + x["size"]).alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct((at + x["size"]).alias("at"), F.when(x["kept"], F.array_append(acc["block"], place)).otherwise(acc["block"]).alias("block"))

    def places(dealt: Column) -> Column:
        sizes = F.transform(dealt, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["size"]))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        return F.flatten(F.zip_with(dealt, F.slice(begins, F.lit(1), F.size(dealt)), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("block")), step, lambda acc: acc["block"])))

    walked = bound(both, lambda z: F.when(F.size(z["found"]) > 0, bound(rows(z), lambda r: bound(blocks(r), places))))
    return F.coalesce(walked, empty)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    back = F.reverse(number)
    doubled = F.transform(F.split(back, ""), lambda d, i: F.when(i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int")).otherwise((F.try_to_number(d, F.lit("9")) * 2).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)) - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))
    if kind == "card":
        n = F.length(digits(value))
        return F.when((n >= 12) & (n <= 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind>> of all kinds, sorted by start and then kind."""
    none = F.array().cast(SPAN)

    def of(rank: int, kind: str) -> Column:
        kept = located(text, PATTERNS[kind], lambda value: F.coalesce(valid(kind, value), F.lit(False)))
        spans = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))
        return F.when(text.rlike(SIGN[kind]), spans).otherwise(none)

    return F.array_sort(F.concat(*(of(i, k) for i, k in enumerate(KINDS))))


def shape(value: Column) -> Column:
    """Digits as 9 (short runs as one), without a leading plus, spaces, dashes and brackets alike; all addresses have one
    shape. So a number in national form has the patterns of those with a country's code."""
    nines = F.regexp_replace(F.regexp_replace(F.ltrim(value, F.lit("+")), "[0-9]", "9"), r"[\x20()-]+", " ")
    return F.when(value.rlike("[A-Za-z@]"), "a@a").otherwise(F.regexp_replace(F.trim(nines), "(?<!9)9{1,3}(?!9)", "9"))


def candidates(text: Column) -> Column:
    """array<struct<start, end, value, shape, left, right>>: runs that look like a number or an address."""
    word = lambda c, p: F.regexp_replace(F.lower(F.regexp_extract(c, p, 1)), "[0-9]", "")
    kept = located(text, CANDIDATE, lambda value: (F.length(digits(value)) >= 7) | ~value.rlike("^[0-9().+ -]*$"))
    rows = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), shape(x["value"]).alias("shape"), word(x["before"], r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$").alias("left"), word(x["after"], r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)").alias("right")))
    return F.when(text.rlike(r"[0-9@]|\(at\)|\x20at\x20[A-Za-z0-9-]+\.[A-Za-z0-9]"), rows).otherwise(F.array().cast("array<struct<start:int,end:int,value:string,shape:string,left:string,right:string>>"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def patterns_of(c: Column) -> Column:
    """The lexical patterns of a candidate: word before, word after, both."""
    return F.array(F.concat_ws("\u0001", F.lit("l"), c["left"], c["shape"]), F.concat_ws("\u0001", F.lit("r"), c["right"], c["shape"]), F.concat_ws("\u0001", F.lit("lr"), c["left"], c["right"], c["shape"]))


def accepted(found: DataFrame, scratch: Scratch, rounds: int = ROUNDS, seeds: int = SEEDS, confident: float = CONFIDENT) -> DataFrame:
    """(value, kind) of unknown instances that high-confidence patterns name."""
    one = found.select("base", F.explode("candidates").alias("c"))
    seed = F.element_at(F.filter("base", lambda b: (b["start"] < F.col("c")["end"]) & (b["end"] > F.col("c")["start"])), 1)
    has = F.exists("base", lambda b: (b["start"] < F.col("c")["end"]) & (b["end"] > F.col("c")["start"]))
    edges = one.select(F.explode(patterns_of(F.col("c"))).alias("pattern"), F.col("c.value").alias("value"), F.when(has, seed["kind"]).alias("kind"))
    edges = scratch.keep(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
    scores = edges.where("false").select("value", F.col("kind").alias("own"), F.array(F.struct(F.lit(0.0).alias("score"), F.col("pattern"))).alias("two"))
    for k in range(rounds):
        # seeds count 1 for their kind, unknown instances what they have reached
        known = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n_seeds"))
        size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        # an instance lends a pattern what it has from another one, or the two would raise each other
        other = F.coalesce(F.get(F.filter("two", lambda t: t["pattern"] != F.col("pattern")), 0)["score"], F.lit(0.0))
        gained = edges.where("kind is null").select("pattern", "value").join(scores, "value").groupBy("pattern", F.col("own").alias("kind")).agg(F.sum(other).alias("gained"))
        pattern = known.where(F.col("n_seeds") >= seeds).join(size, "pattern").join(gained, ["pattern", "kind"], "left")
        pattern = pattern.select("pattern", F.col("kind").alias("own"), ((F.col("n_seeds") + F.coalesce("gained", F.lit(0.0))) / F.col("n")).alias("score"))
        held = edges.where("kind is null").select("pattern", "value").join(pattern, "pattern")
        order = Window.partitionBy("value", "own").orderBy(F.desc("score"), "pattern")
        top = held.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2)
        scores = scratch.keep(top.groupBy("value", "own").agg(F.sort_array(F.collect_list(F.struct("score", "pattern")), asc=False).alias("two")), f"scores{k}")
    scores = scores.select("value", "own", F.get("two", 0)["score"].alias("score"))
    best = F.max(F.struct("score", "own"))
    return scores.where(F.col("score") >= confident).groupBy("value").agg(best.alias("b")).select("value", F.col("b.own").alias("kind"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, added): base spans of every row and the spans that the method adds; key is a hash of id and text."""
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), base_spans(text).alias("base"), candidates(text).alias("candidates"))
    found = scratch.keep(rows, "found")
    good = scratch.keep(accepted(found, scratch), "accepted")
    one = found.select("doc_id", "key", "base", F.explode("candidates").alias("c"))
    free = ~F.exists("base", lambda b: (b["start"] < F.col("c")["end"]) & (b["end"] > F.col("c")["start"]))
    rank = reduce(lambda a, k: a.when(F.col("kind") == KINDS[k], k), range(1, len(KINDS)), F.when(F.col("kind") == KINDS[0], 0))
    more = one.where(free).select("doc_id", "key", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.value").alias("value")).join(good, "value")
    more = more.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind"))).cast(SPAN).alias("added"))
    more = scratch.keep(more, "added")
    out = found.select("doc_id", "key", "base").join(more, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    return out.select("doc_id", "key", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each row."""
    number = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *(number(k) for k in KINDS), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; overlapping spans by the first one's. Nulls stay."""
    found = find(docs).select(F.col("doc_id").alias("_id"), F.col("key").alias("_k"), F.array_sort(F.concat("base", "added")).alias("_spans")).where(F.size("_spans") > 0).distinct()
    found = Scratch(docs.sparkSession, "redact").keep(found, "spans")
    rows = carried(docs, F.col("text").alias("_text"), F.col("doc_id").alias("_doc"), F.xxhash64("doc_id", "text").alias("_key"))
    rows = rows.join(found, (F.col("_key") == F.col("_k")) & F.col("_doc").eqNullSafe(F.col("_id")), "left")
    text = F.col("_text")
    done = F.aggregate(
        F.col("_spans"),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        ),
    )
    clean = F.when(F.col("_spans").isNull(), text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.char_length(text))))
    return restored(rows, docs.columns, text=clean)
