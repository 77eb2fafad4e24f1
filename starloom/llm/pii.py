r"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are the e-mail addresses, IP addresses, card and phone numbers that fixed patterns find. Every token with a
digit or an at sign is a candidate; its neighbouring words form lexical patterns (word before and after; two words
before; a label such as ``phone:`` or ``id=``). The bipartite graph of patterns and candidate values is scored
``ROUNDS`` times: a pattern's confidence in a kind is the summed score of its values over their number plus one, a
value's score is one minus the product of its patterns' doubts, and seeds keep the score one. Values that reach
``ACCEPT`` are identifiers of that kind wherever they occur. Sums are combined before each shuffle and the graph is
stored, so a common word pair does not gather its rows in a task.

Spans hold code-point offsets, end exclusive. Defined cases: null and empty texts have no spans; texts of any
length are read whole (the patterns are linear and do not recurse); rows that repeat an id and text get the same
spans; a null id is an id of its own; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from starloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
ACCEPT = 0.8
LONGEST, SHORTEST = 64, 4

# The fixed patterns, written without backtracking into a run: possessive, and tried only at the start of a run or
# where the last match ended, which finds the same leftmost matches.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A candidate is a phone or card number that fills its tokens, or one token with a digit or an at sign.
FILLS = "(?![^\\s.,;:!?)\\]}\"'])"
CANDIDATE = rf"{PATTERNS['phone']}{FILLS}|(?<!\S){PATTERNS['card']}{FILLS}|(?<!\S)[^\s0-9@]*+[0-9@]\S*+"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)

    def weighed(i: Column) -> Column:
        digit = F.ascii(F.substring(digits, n - i + 1, F.lit(1))) - 48
        doubled = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), weighed), F.lit(0), lambda a, d: a + d)
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(False)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: F.coalesce(part.try_cast("long") <= 255, F.lit(False)))
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches in order: array of (start, match, before, after), with the text between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(
        found.alias("match"), F.slice(gaps, 1, F.size(found)).alias("before"), F.slice(gaps, 2, F.size(found)).alias("after")
    )
    kind = "array<struct<start:int,match:string,before:string,after:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(state: Column, one: Column) -> Column:
        begin = (state["at"] + F.length(one["before"])).cast("int")
        row = F.struct(begin.alias("start"), one["match"].alias("match"), one["before"].alias("before"), one["after"].alias("after"))
        return F.struct((begin + F.length(one["match"])).cast("int").alias("at"), F.concat(state["out"], F.array(row)).alias("out"))

    walked = F.aggregate(pairs, start, step, lambda state: state["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), walked).otherwise(F.array().cast(kind))


def base_spans(text: Column) -> Column:
    """Spans that the fixed patterns find: array of (start, rank of the kind, end), sorted."""
    text = F.coalesce(text, F.lit(""))

    def of(rank: int, kind: str) -> Column:
        good = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["match"]))
        return F.transform(
            good,
            lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), (m["start"] + F.length(m["match"])).alias("end")),
        )

    return F.array_sort(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)]))


def _bare(word: Column) -> Column:
    return F.lower(F.btrim(word, F.lit(".,;:!?\"'()[]{}<>")))


def candidates(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per candidate token: keys, value, start, end, rank of the seed it holds (or null), its lexical patterns."""
    one = docs.where(F.regexp_like(F.col(text), F.lit("[0-9@]")))
    found = one.select(*keys, "_base", F.explode(matches(F.col(text), CANDIDATE)).alias("_m"))
    edge = F.lit(".,;!?\"'()[]{}<>")
    label = F.regexp_extract("_token", r"^([^\s0-9@]*[=:])[^=:]", 1)  # id=… or tel:…
    value = F.expr("substring(_token, length(_label) + 1)")
    flat = lambda column: F.translate(column, "\n\t\r", "   ")
    rows = found.select(
        *keys, "_base", F.col("_m.start").alias("_from"), F.col("_m.match").alias("_token"),
        F.rtrim(flat(F.col("_m.before"))).alias("_before"), F.ltrim(flat(F.col("_m.after"))).alias("_after"),
    ).withColumn("_label", label).withColumn("_raw", value)
    rows = rows.withColumn("_value", F.btrim("_raw", edge)).withColumn(
        "start", F.col("_from") + F.length("_label") + F.length("_raw") - F.length(F.ltrim(F.col("_raw"), edge))
    ).withColumn("end", F.col("start") + F.length("_value"))
    overlapping = F.filter("_base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    last, two = F.substring_index("_before", " ", -1), F.substring_index("_before", " ", -2)
    named = F.when(F.length("_label") > 0, F.lower("_label")).otherwise(F.when(last.rlike("[=:]$"), F.lower(last)))
    lexical = F.array_compact(
        F.array(
            F.when((F.length("_before") > 0) & (F.length("_after") > 0), F.concat(F.lit("around "), _bare(last), F.lit(" "), _bare(F.substring_index("_after", " ", 1)))),
            F.when(F.locate(" ", F.ltrim(two)) > 0, F.concat(F.lit("after "), _bare(two))),
            F.concat(F.lit("label "), named),
        )
    )
    return rows.select(
        *keys, "start", "end", F.sha2(F.lower("_value"), 256).alias("value"),
        F.when(F.size(overlapping) > 0, F.get(overlapping, F.lit(0))["rank"]).alias("seed"), lexical.alias("patterns"),
    ).where((F.col("end") - F.col("start")).between(SHORTEST, LONGEST) | F.col("seed").isNotNull())


def score_values(found: DataFrame) -> DataFrame:
    """Score the graph of patterns and values: (value, rank, score) of values that are no seeds and reach ACCEPT."""
    edges = cut_lineage(found.select(F.explode("patterns").alias("pattern"), "value").distinct())
    seeds = cut_lineage(found.where(F.col("seed").isNotNull()).select("value", F.col("seed").alias("rank")).distinct())
    sizes = cut_lineage(edges.groupBy("pattern").agg(F.count("value").alias("values")))
    scores = seeds.withColumn("score", F.lit(1.0))
    for _ in range(ROUNDS):
        sums = edges.join(scores, "value").groupBy("pattern", "rank").agg(F.sum("score").alias("sum"))
        trust = sums.where(F.col("sum") >= 2).join(sizes, "pattern")  # one value alone proves nothing
        trust = trust.select("pattern", "rank", (F.col("sum") / (F.col("values") + 1)).alias("trust"))
        doubts = edges.join(trust, "pattern").groupBy("value", "rank").agg(F.sum(F.log(1 - F.col("trust"))).alias("doubt"))
        fresh = doubts.join(seeds.select("value"), "value", "left_anti").select("value", "rank", (1 - F.exp("doubt")).alias("score"))
        scores = cut_lineage(seeds.withColumn("score", F.lit(1.0)).unionByName(fresh))
    new = scores.join(seeds.select("value"), "value", "left_anti").where(F.col("score") >= ACCEPT)
    best = new.groupBy("value").agg(F.max(F.struct("score", -F.col("rank"))).alias("_best"))
    return best.select("value", (-F.col("_best")["col2"]).alias("rank"), F.col("_best.score").alias("score"))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with ``into``: array of (start, rank, end, base) sorted by start; rank numbers KINDS, base marks seeds.

    Other columns stay whatever their names are: the work is done on renamed copies of the id and the text.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(doc_id).alias("_id"), content.alias("_text"), F.xxhash64(content).alias("_hash"))
    found = cut_lineage(candidates(own.withColumn("_base", base_spans(F.col("_text"))), "_text", ["_id", "_hash"]))
    new = found.where(F.col("seed").isNull()).join(score_values(found), "value")
    added = new.select("_id", "_hash", F.struct("start", "rank", "end").alias("_span")).distinct()
    added = added.groupBy("_id", "_hash").agg(F.collect_set("_span").alias("_added"))
    added = added.withColumnsRenamed({"_id": "_pii_id", "_hash": "_pii_hash", "_added": "_pii_added"})
    joined = docs.withColumns({"_pii_base": base_spans(F.col(text)), "_pii_key": F.xxhash64(content)}).join(
        added, F.col(doc_id).eqNullSafe(F.col("_pii_id")) & (F.col("_pii_key") == F.col("_pii_hash")), "left"
    )

    def marked(spans: Column, base: bool) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.lit(base).alias("base")),
        )

    extra = F.coalesce(marked(F.col("_pii_added"), False), F.filter(marked(F.col("_pii_base"), False), lambda s: F.lit(False)))
    every = F.array_sort(F.concat(marked(F.col("_pii_base"), True), extra))
    return joined.withColumn(into, every).drop("_pii_base", "_pii_key", "_pii_id", "_pii_hash", "_pii_added")


def of_kind(kind: str):
    """Predicate on spans of one kind."""
    return lambda span: span["rank"] == KINDS.index(kind)


def described(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    parts = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones together) replaced by ``<KIND>``."""
    kinds = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        between = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(state["out"], between, F.get(kinds, s["rank"])).alias("out"))
        inside = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
        return F.when(s["start"] >= state["at"], fresh).otherwise(inside)

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)


def mask_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``<KIND>``; all columns stay."""
    found = find_pii(docs, doc_id, text, into="_pii_spans")
    return found.withColumn(text, masked(F.col(text), F.col("_pii_spans"))).drop("_pii_spans")
