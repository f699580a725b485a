"""Personal data by bootstrapped contextual extraction (operator 6), in DataFrame operations only.

Four base patterns find e-mail addresses, IP addresses, card numbers and telephone numbers. Every piece of text that looks
like an identifier (words with digits or an at sign, side by side) is an instance, and the words around it and a cue in
front of it (`name=`) are its lexical patterns. Seeds are the instances that a base pattern finds, and, for secrets, those
that have the shape of a key in hexadecimal digits; by their shape alone these are no finds. Patterns and instances form a
graph that is scored in rounds: a pattern's confidence in a kind is the mean score of its distinct instances in that kind;
an instance's score is one minus the product of what its trusted patterns leave. Instances of a high score, of whatever
shape, join the known ones, whose patterns may be trusted in the next round; the rounds end when none joins. What trusted
patterns find beyond the base patterns is added as spans of the patterns' kind, key-shaped instances included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of, written

#: The kinds in the order in which spans are listed. A match may start where a run of its characters starts or the last
#: match ended: from any other place it would need what already failed. Possessive repeats, as nothing is given back.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that only patterns find, after the others in lists of spans.
MORE_KINDS = ("secret",)
#: The shape of a secret that is taken for a seed: 128, 160 or 256 bits in hexadecimal digits, letters among them.
KEY_SHAPE = r"^(?=.*[0-9])(?=.*[a-f])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
WS = r"\x20\x09-\x0D"
#: Words that hold a digit or an at sign, and the words with a digit that follow them.
INSTANCE = rf"(?<![^{WS}])[^{WS}0-9@]*+[0-9@][^{WS}]*+(?:\x20[^{WS}0-9]*+[0-9][^{WS}]*+)*+"
#: A pattern is trusted from this confidence on, if it has so many distinct instances of the kind.
TRUSTED, SUPPORT = 0.9, 5
#: An instance is added from this score on.
ADDED = 0.9
SPAN = "array<struct<kind:int,start:int,end:int>>"


#: Matches whose places are added up one after the other.
TOGETHER = 256
FOUND = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def matched(text: Column, regex: str, worth: Column) -> Column:
    """Of each match: the match, the text before it from the last match on, and the text after it up to the next."""
    found = F.when(worth, F.regexp_extract_all(text, F.lit(regex), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.split(text, regex, -1)
    all_three = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), F.slice(gaps, 2, F.size(found)).alias("a"))
    return F.when(F.size(found) > 0, all_three).otherwise(F.array().cast("array<struct<m:string,g:string,a:string>>"))


def located(matches: Column) -> Column:
    """Start and end of each match in code points, with its texts. matches is a column from matched().

    Places are summed in blocks of TOGETHER matches, so that many matches in one text cost no more than in proportion.
    """
    length = lambda x: F.length(x["g"]) + F.length(x["m"])
    number = F.floor((F.size(matches) - 1) / TOGETHER).cast("int")
    block = lambda i: F.slice(matches, i * TOGETHER + 1, TOGETHER)
    begin = F.aggregate(
        F.sequence(F.lit(0), number),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<i:int,at:int>>").alias("out")),
        lambda acc, i: F.struct(
            F.aggregate(block(i), acc["at"], lambda at, x: at + length(x)).alias("at"),
            F.concat(acc["out"], F.array(F.struct(i.alias("i"), acc["at"].alias("at")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )

    def placed(at: Column, x: Column) -> Column:
        start = at + F.length(x["g"])
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("match"), x["g"].alias("before"), x["a"].alias("after"))

    places = F.transform(
        begin,
        lambda b: F.aggregate(
            block(b["i"]),
            F.struct(b["at"].alias("at"), F.array().cast(FOUND).alias("out")),
            lambda acc, x: F.struct((acc["at"] + length(x)).alias("at"), F.concat(acc["out"], F.array(placed(acc["at"], x))).alias("out")),
            lambda acc: acc["out"],
        ),
    )
    return F.when(F.size(matches) > 0, F.flatten(places)).otherwise(F.array().cast(FOUND))


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _worth(text: Column) -> dict[str, Column]:
    """Whether a text can have a match of a kind at all."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][0-9 -]{14}"), "phone": text.contains("+")}


def _base() -> Column:
    """All valid spans of the four kinds, in the order of the kinds, from the columns of their matches."""

    def spans(n: int, kind: str) -> Column:
        kept = F.filter(located(F.col(f"__{kind}")), lambda x: valid(kind, x["match"]))
        return F.transform(kept, lambda x: F.struct(F.lit(n).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    return F.concat(*(spans(n, kind) for n, kind in enumerate(KINDS))).cast(SPAN)


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, (*KINDS, *MORE_KINDS)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _clean(word: Column) -> Column:
    """A word of a context: in lower case, without marks at its ends. An equals sign or colon alone stays."""
    bare = F.lower(F.regexp_replace(word, r"^[\p{Punct}]+|[\p{Punct}]+$", ""))
    return F.when(word.isin("=", ":"), word).otherwise(bare)


def _occurrences(rows: DataFrame) -> DataFrame:
    """(rid, start, end, instance, base, kind, patterns) of every instance.

    base: whether it overlaps a base span; kind: that span's, or the one that it is a seed of. Contexts are whole words of
    the text between the instance and its neighbours.
    """
    word = lambda column, regex, n: _clean(F.regexp_extract(column, regex, n))
    left = rf"(?:(?<![^{WS}])([^{WS}]++)[{WS}]++)?+(?<![^{WS}])([^{WS}]++)[{WS}]*+$"
    one = rows.select("rid", F.explode("instances").alias("i"))
    one = one.select("rid", F.col("i.start").alias("at"), F.col("i.match").alias("match"), word("i.before", left, 2).alias("w1"), word("i.before", left, 1).alias("w2"), word("i.after", rf"^[{WS}]*+([^{WS}]++)", 1).alias("r1"))
    # a cue is part of the match; marks around what is left are no part of the instance, but for those that numbers begin and end with
    one = one.withColumn("cue", F.regexp_extract("match", rf"^([^=:0-9{WS}]++[=:])", 1))
    one = one.withColumn("rest", F.expr("substr(match, length(cue) + 1)"))
    one = one.withColumn("skip", F.length(F.regexp_extract("rest", r"^[\p{Punct}&&[^+(]]*+", 0)))
    one = one.withColumn("body", F.regexp_replace(F.expr("substr(rest, skip + 1)"), r"(?<![\p{Punct}&&[^)]])[\p{Punct}&&[^)]]++$", "")).where("body != ''")
    start = F.col("at") + F.length("cue") + F.col("skip")
    patterns = F.array(
        F.when(F.col("w1") != "", F.concat(F.lit("before|"), "w1")),
        F.when((F.col("w1") != "") & (F.col("w2") != ""), F.concat_ws("|", F.lit("before"), "w2", "w1")),
        F.when((F.col("w1") != "") & (F.col("r1") != ""), F.concat_ws("|", F.lit("around"), "w1", "r1")),
        F.when(F.col("cue") != "", F.concat(F.lit("cue|"), F.lower("cue"))),
    )
    one = written(one.select("rid", start.alias("start"), (start + F.length("body")).alias("end"), F.lower("body").alias("instance"), F.array_compact(patterns).alias("patterns")))
    # spans that overlap have a stretch of 64 characters in common
    stretches = lambda: F.explode(F.sequence(F.shiftright("start", 6), F.shiftright(F.col("end") - 1, 6)))
    spans = rows.select("rid", F.inline("base")).withColumn("stretch", stretches())
    places = one.select("rid", F.col("start").alias("from"), F.col("end").alias("to"), stretches().alias("stretch"))
    met = places.join(spans, ["rid", "stretch"]).where((F.col("start") < F.col("to")) & (F.col("end") > F.col("from")))
    over = met.groupBy("rid", F.col("from").alias("start")).agg(F.min("kind").alias("over"))
    kind = F.coalesce("over", F.when(F.col("instance").rlike(KEY_SHAPE), len(KINDS)))
    return one.join(over, ["rid", "start"], "left").select("rid", "start", "end", "instance", F.col("over").isNotNull().alias("base"), kind.alias("kind"), "patterns")


def bootstrap(occurrences: DataFrame, trusted: float = TRUSTED, support: int = SUPPORT, added: float = ADDED) -> DataFrame:
    """(rid, kind, start, end) of the instances that trusted patterns find and no base pattern does.

    Known instances only grow, by at least one a round, so the rounds come to an end.
    """
    edges = written(occurrences.select(F.explode("patterns").alias("pattern"), "instance", "kind").groupBy("pattern", "instance").agg(F.min("kind").alias("kind")))
    seeds = written(edges.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0)))
    size = written(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support))
    known = seeds
    while True:
        per = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("m"))
        sure = per.where(F.col("m") >= support).join(size, "pattern").withColumn("confidence", F.col("s") / F.col("n")).where(F.col("confidence") >= trusted)
        found = edges.join(sure.select("pattern", F.col("kind").alias("k"), "confidence"), "pattern")
        score = 1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("confidence")))))
        scored = found.groupBy("instance").agg(F.max_by("k", F.struct("confidence", -F.col("k"))).alias("kind"), score.alias("score"))
        more = written(scored.where(F.col("score") >= added).join(known.select("instance"), "instance", "left_anti"), narrow=True)
        if not more.take(1):
            break
        known = written(known.unionByName(more), narrow=True)
    # a seed by its shape alone is a find where a trusted pattern has it
    new = scored.where(F.col("score") >= added).select("instance").join(known, "instance").select("instance", F.col("kind").alias("k"))
    return occurrences.where("not base").join(new, "instance").select("rid", F.col("k").alias("kind"), "start", "end")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; code points, end exclusive) for each row of docs.

    spans holds the base spans and those that bootstrapping adds. Null and empty texts have none; repeated rows have the
    same; an empty table gives an empty result. Texts are searched whole. Other columns are not read.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), text_of(docs, text_col).alias("text"))
    worth = F.col("text").rlike("[0-9@]")
    of = {kind: matched(F.col("text"), KINDS[kind], worth & w) for kind, w in _worth(F.col("text")).items()} | {"instance": matched(F.col("text"), INSTANCE, worth)}
    rows = text.select(F.monotonically_increasing_id().alias("rid"), "doc_id", *(m.alias(f"__{name}") for name, m in of.items()))
    rows = rows.withColumns({"base": _base(), "instances": located(F.col("__instance"))})
    rows = written(rows.select("rid", "doc_id", "base", "instances"))
    occurrences = written(_occurrences(rows))
    new = bootstrap(occurrences).groupBy("rid").agg(F.collect_set(F.struct("kind", "start", "end")).cast(SPAN).alias("new"))
    return rows.select("rid", "doc_id", "base").join(new, "rid", "left").select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("new", F.array().cast(SPAN)))).alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    counts = [count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), added, F.size("spans").cast("long").alias("n_spans"))
