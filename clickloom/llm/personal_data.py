"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions alone.

Seeds are the identifiers that four base patterns find, and words that look like secrets (SECRET: long, of hexadecimal digits). Their
contexts (the word before and the word after) induce lexical patterns. In each of ROUNDS rounds Spark scores the graph of patterns
and instances by grouped aggregates: a pattern by the share of known identifiers among what it surrounds, an instance by the patterns
around it; instances of high belief are promoted, and count as known when patterns are induced again. At last words that
trusted patterns surround on both sides, or on one side if a known identifier of that kind has their form, become spans. The base
spans stay. A seed secret is no span by its look alone: trusted patterns must surround it too.

Positions are code points. A base pattern is found by splitting the text at its matches: the gaps' and the matches' lengths,
summed in order, are the positions. They are summed in blocks of BLOCK matches, so the time for a text of n matches grows with n * BLOCK
and n * n / BLOCK**2. The patterns are written so that the Java matcher neither recurses nor starts again inside a
run that has failed as a whole, which leaves the leftmost matches as they are.

A context reaches NEAR characters, and only words of SHORTEST characters or more with a digit are candidates beside the base matches.
Null and empty texts have no spans; very long texts are read whole; overlapping kinds are all kept; repeated rows give equal spans, and
rows count as documents by their ids. A null doc_id is an id of its own here. Without seeds there are no patterns, and nothing is discovered. An empty table
gives no rows. Other columns are carried along, whatever their names but that of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import joined, split_by_ids, written

KINDS = ["email", "ip", "card", "phone"]
#: Kinds of all spans, in the order in which they are listed.
ALL_KINDS = [*KINDS, "secret"]
_LOCAL = r"[A-Za-z0-9._%+-]"
#: A match may only start where a run starts or the last match ended: inside a run that failed every start fails.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
_NEEDS = {"email": ("@",), "ip": (".",), "card": (), "phone": ("+",)}

#: Rounds of scoring, known instances that a pattern needs (see trusted), and the confidences at which a pattern and a word are taken.
ROUNDS, SUPPORT, PATTERN_CONFIDENCE, WORD_CONFIDENCE = 3, 3, 0.8, 0.75
#: Share of a pattern's known instances that its commonest kind needs.
KIND_SHARE = 0.8
#: Belief at which an instance counts as known in the next round.
PROMOTION = 0.95
#: Candidates have so many characters at least; contexts reach so far.
SHORTEST, NEAR = 6, 200
_WORD = rf"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]{{{SHORTEST},}})(?=[^0-9\x20\x09-\x0D]*[0-9])[^\x20\x09-\x0D]++"
#: The look of a secret, in quotes or not: 32 hexadecimal digits or more, letters and digits among them.
SECRET = r"^[\"']?(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}[\"']?[^0-9A-Za-z\"']*$"
#: Matches whose positions are summed together.
BLOCK = 64

SPAN = "struct<kind:string, start:int, end:int, value:string>"


_PLACED = "array<struct<start:int, end:int, value:string>>"


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once: what a lambda refers to by an expression would be worked out again for each element."""
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str) -> Column:
    """Structs (start, end, value) of all matches of a pattern, in order."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = _let(found, lambda values: F.arrays_zip(F.slice(gaps, F.lit(1), F.size(values)).alias("gap"), values.alias("value")))
    return _let(pairs, lambda own: F.when(F.size(own) <= BLOCK, _placed(own, F.lit(0))).otherwise(_in_blocks(own)))


def _placed(pairs: Column, first: Column) -> Column:
    """Positions of consecutive matches, the first gap beginning at first."""
    zero = F.struct(first.alias("at"), F.array().cast(_PLACED).alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    return F.aggregate(pairs, zero, step, lambda state: state["out"])


def _in_blocks(pairs: Column) -> Column:
    numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))

    def place(own: Column) -> Column:
        sums = F.transform(own, lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + y["gap"] + F.length(y["value"])))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return _let(starts, lambda firsts: F.flatten(F.transform(own, lambda x, k: _placed(x, F.get(firsts, k)))))

    return _let(blocks, place)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        double = d * 2
        return total + F.when(k % 2 == 0, d).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$")
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with `base`: spans of the four kinds, by kind as listed, then by start."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs
    for kind in KINDS:
        needs = text.rlike("[0-9]{2}|[0-9][ -][0-9]") if kind == "card" else F.lit(True)
        for c in _NEEDS[kind]:
            needs = needs & text.contains(c)
        if kind == "ip":
            needs = needs & text.rlike(r"[0-9]\.[0-9]++\.[0-9]")
        found = F.when(needs, _matches(text, PATTERNS[kind])).otherwise(F.array().cast("array<struct<start:int, end:int, value:string>>"))
        out = out.withColumn(f"_{kind}", found)
    def kept(kind: str) -> Column:
        valid = F.filter(F.col(f"_{kind}"), lambda x: _valid(kind, x["value"]))
        return F.transform(valid, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))

    parts = [kept(kind) for kind in KINDS]
    return out.withColumn("base", F.concat(*parts)).drop(*(f"_{kind}" for kind in KINDS))


def _before(text: Column, start: Column) -> Column:
    """The word before a position, lower-case, digits as 0; empty at a line's start."""
    near = F.substring(text, F.greatest(start - NEAR, F.lit(0)) + 1, F.least(start, F.lit(NEAR)))
    return F.regexp_replace(F.lower(F.regexp_extract(near, r"([^\x20\x09-\x0D]+[\x20\x09]*(?:[=:][\x20\x09]*[\"']?)?)$", 1)), "[0-9]+", "0")


def _after(text: Column, end: Column) -> Column:
    """What follows a position up to the end of the next word, in the same form."""
    near = F.substring(text, end + 1, F.lit(NEAR))
    return F.regexp_replace(F.lower(F.regexp_extract(near, r"^([\"']?[\x20\x09]*[^\x20\x09-\x0D]*)", 1)), "[0-9]+", "0")


def _shape(value: Column) -> Column:
    """Form of an identifier: runs of letters a, capitals A, digits 0; other characters stay."""
    s = F.regexp_replace(value, "[0-9]+", "0")
    s = F.regexp_replace(s, r"\p{Lu}+", "A")
    return F.regexp_replace(s, r"\p{Ll}+", "a")


def occurrences(spans: DataFrame) -> DataFrame:
    """Seeds and identifier-like words of rows (_row, doc_id, text, base) with their contexts: _row, doc_id, kind (null if not known), base (whether a base pattern found it), start, end, value, and context patterns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.when(text.rlike("[0-9]"), _matches(text, _WORD)).otherwise(F.array().cast(_PLACED))
    free = F.filter(words, lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    as_seed = lambda b: F.struct(b["kind"].alias("kind"), F.lit(True).alias("base"), b["start"].alias("start"), b["end"].alias("end"), b["value"].alias("value"))
    as_word = lambda w: F.struct(F.when(w["value"].rlike(SECRET), "secret").alias("kind"), F.lit(False).alias("base"), w["start"].alias("start"), w["end"].alias("end"), w["value"].alias("value"))
    rows = spans.select("_row", "doc_id", "text", F.explode(F.concat(F.transform("base", as_seed), F.transform(free, as_word))).alias("x"))
    left, right = _before(text, F.col("x.start")), _after(text, F.col("x.end"))
    contexts = F.filter(F.array(F.concat(F.lit("<"), left), F.concat(F.lit(">"), right), F.concat(F.lit("="), left, F.lit("|"), right)), lambda p: ~p.isin("<", ">", "=|") & ~p.startswith("=|") & ~p.endswith("|"))
    return rows.select("_row", "doc_id", "x.kind", "x.base", "x.start", "x.end", "x.value", contexts.alias("contexts"))


def trusted(found: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns, known): patterns of high confidence with the commonest kind of their known instances, and the values that are known at last with their kinds, promoted ones among them.

    A pattern needs SUPPORT known instances of its commonest kind, an instance counted once for each document, in two documents at least; and that kind
    must have KIND_SHARE of all its known instances. Its confidence is the mean score of its distinct instances: 1 if known, else the belief of the round before.
    """
    edges = written(found.select(F.explode("contexts").alias("pattern"), "value", "kind", "doc_id").groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.approx_count_distinct(F.coalesce("doc_id", F.lit(-1))).alias("docs"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")), 8)
    known = written(edges.where("kind is not null").groupBy("value").agg(F.max("kind").alias("known_kind")), 8)
    good = belief = None
    for turn in range(rounds):
        own = edges.join(known, "value", "left")
        if belief is not None:
            own = own.join(belief.select("value", "belief"), "value", "left")
        score = F.when(F.col("known_kind").isNotNull(), 1.0).otherwise(F.coalesce("belief", F.lit(0.0)) * 0.5 if belief is not None else 0.0)
        by_kind = own.groupBy("pattern", "known_kind").agg(F.sum("docs").alias("docs"), _two("a", "b").alias("least"), F.sum(score).alias("score"), F.count("*").alias("n"))
        seeds = F.when(F.col("known_kind").isNotNull(), F.col("docs"))
        scored = by_kind.groupBy("pattern").agg(
            F.sum(seeds).alias("every"), F.max(F.when(F.col("known_kind").isNotNull(), F.struct("docs", "known_kind", "least"))).alias("top"), (F.sum("score") / F.sum("n")).alias("confidence")
        )
        good = scored.where((F.col("top.docs") >= SUPPORT) & (F.col("top.docs") >= KIND_SHARE * F.col("every")) & F.col("top.least")).select("pattern", F.col("top.known_kind").alias("seed_kind"), "confidence")
        good = written(good, 8)
        if turn == rounds - 1:
            break
        joint = joined(edges.select("pattern", "value"), good, "pattern", "inner")
        belief = written(joint.groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("belief"), F.max_by("seed_kind", F.struct("confidence", "seed_kind")).alias("promoted")), 8)
        both = known.select("value", F.col("known_kind").alias("own"), F.lit(None).cast("string").alias("promoted")).unionByName(belief.where(F.col("belief") >= PROMOTION).select("value", F.lit(None).cast("string").alias("own"), "promoted"))
        known = written(both.groupBy("value").agg(F.coalesce(F.max("own"), F.max("promoted")).alias("known_kind")), 8)
    return written(good.where(F.col("confidence") >= PATTERN_CONFIDENCE), 8), known


def _two(a: str, b: str) -> Column:
    """Whether instances come from more documents than one."""
    return F.coalesce(F.min(a) < F.max(b), F.lit(False))


def discovered(found: DataFrame, patterns: DataFrame, known: DataFrame) -> DataFrame:
    """_row and the spans of words that trusted patterns surround: on one side, if a known instance of that kind has the word's form, on both sides whatever its form."""
    kinds = known.select(F.col("known_kind").alias("seed_kind"), _shape(F.col("value")).alias("shape")).distinct()
    rows = found.where(~F.col("base")).select("_row", "start", "end", "value", F.explode("contexts").alias("pattern"))
    near = joined(rows, patterns, "pattern", "inner").withColumn("shape", _shape(F.col("value")))
    sure = near.join(kinds.withColumn("like", F.lit(1)), ["seed_kind", "shape"], "left")
    belief = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence") * F.when(F.col("like") == 1, 1.0).when(F.col("pattern").startswith("="), 0.9).otherwise(0.0), F.lit(1e-9)))))
    each = sure.groupBy("_row", "start", "end", "value").agg(belief.alias("belief"), F.max_by("seed_kind", F.struct("confidence", "seed_kind")).alias("kind")).where(F.col("belief") >= WORD_CONFIDENCE)
    # quotes and marks around an identifier are not part of it
    bare = F.regexp_extract("value", r"^[\"'(\[<]*(.*?)[\"'()\[\]<>,.;:!?*#%$&]*$", 1)
    skipped = F.length(F.regexp_extract("value", r"^[\"'(\[<]*", 0))
    inner = each.withColumn("start", F.col("start") + skipped).withColumn("value", bare).where("length(value) > 0").withColumn("end", F.col("start") + F.length("value"))
    return inner.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end", "value"))).alias("more"))


def personal_data(docs: DataFrame) -> DataFrame:
    """docs with `base` spans and `more`, the discovered ones (kind, start, end, value). Rows are numbered and written with their base spans once."""
    marked = written(base_spans(docs).withColumn("_row", F.monotonically_increasing_id()))
    graph = written(occurrences(marked.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "text", "base")))
    more = written(discovered(graph, *trusted(graph)), 8)
    none = F.array().cast(f"array<{SPAN}>")
    likely, others = split_by_ids(marked, more, "_row")
    out = joined(likely, more, "_row", "left").withColumn("more", F.coalesce("more", none)).unionByName(others.withColumn("more", none))
    return out.drop("_row")


def _joint(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _ordered(spans: Column) -> Column:
    """By kind as listed, then start and end."""
    rank = lambda x: F.struct(F.array_position(F.array(*map(F.lit, ALL_KINDS)), x["kind"]).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    return F.array_sort(F.array_distinct(F.transform(spans, rank)))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets (overlapping spans by the first one's), n_chars renewed, their own columns."""
    own = {"base", "more", "_row", "_new", *(f"_{kind}" for kind in KINDS)}
    aside = {c: f"{c}__aside" for c in docs.columns if c.lower() in own}
    found = personal_data(docs.withColumnsRenamed(aside))
    spans = F.array_sort(F.transform(F.concat("base", "more"), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        inside = x["start"] < state["at"]
        return F.struct(F.greatest(state["at"], -x["back"]).alias("at"), F.when(inside, state["out"]).otherwise(F.concat(state["out"], gap, F.lit("<"), x["kind"], F.lit(">"))).alias("out"))

    new = F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    changed = F.when(F.size("base") + F.size("more") > 0, new).otherwise(F.col("text"))
    out = found.withColumn("_new", changed)
    # names are compared without case, as Spark does
    new_columns = {"text": lambda kind: F.col("_new").cast(kind), "n_chars": lambda kind: F.length("_new").cast(kind)}
    return out.select(*(new_columns[f.name.lower()](f.dataType).alias(f.name) if f.name.lower() in new_columns else F.col(f"`{aside.get(f.name, f.name)}`").alias(f.name) for f in docs.schema.fields))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: personal data of every document."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joint(F.col("base")), 256).alias("base_sha256"), _joint(_ordered(F.concat("base", "more"))).alias("spans"))
