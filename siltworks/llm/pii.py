"""Personal data by fixed shapes and bootstrapped contextual extraction, in DataFrame operations only.

Base entities (e-mail, IP, card, phone) are found by shape. Whole, blanks included, they are the seeds: the word before and
the word behind a seed is a lexical pattern. A pattern meets instances, seeds and other identifier-like words alike; that is a bipartite graph.
In each round a pattern's confidence in a kind is the summed score of the instances it meets over their number,
and an instance that is no seed takes the confidence of its best pattern. Patterns that end above ``CONFIDENCE``
with enough seed support discover identifiers of shapes that no rule knows.

At scale: one narrow pass over the texts, which never leave their task; what is stored per document is positions. The graph has one
row per pattern and distinct instance; counts are folded before each shuffle, so a word that stands before a third of all
entities is one key of sums. Confident patterns are broadcast only if their measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltworks.llm.common import let, stored, texts
from siltworks.sources.scratch import cut

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
CONFIDENCE = 0.8
SUPPORT = 5.0  # summed scores behind a confident pattern
SMOOTH = 1.0
MIN_DIGITS, MIN_CHARS = 4, 6  # of an identifier that is discovered; e-mail addresses may do without digits
CONTEXT = 64  # characters looked at for the word next to an entity
MARK = "\x01"

# The base shapes, written so that no input makes them backtrack over a long run: a run is entered at its start, or
# where the match before it ended (\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
# identifier-like: an address that is spelled out, a word with a digit and the digit groups that follow it, or a word with a
# sign between letters
SPELLED = r"(?<!\S)\S++\x20(?i:at|\(at\)|\[at\])\x20\S++(?:\x20(?i:dot|\(dot\)|\[dot\])\x20\S++)++"
NUMBERED = r"(?<!\S)[^\s0-9]*+[0-9]\S*+(?:\x20\(?[0-9][0-9().-]*+(?!\S))*+"
SIGNED = r"(?<!\S)(?=\S*[A-Za-z][._@(\[]++[A-Za-z])\S++"
IDENTIFIER = f"{SPELLED}|{NUMBERED}|{SIGNED}"

SPAN = "struct<start:int,kind:int,end:int>"
ENTITY = "struct<start:int,kind:int,end:int,value:string,left:string,right:string>"
MATCH = "struct<start:int,end:int,value:string,left:string,right:string>"
CHUNK = 64  # pieces whose lengths are summed together


def _matches(text: Column, pattern: str, words: bool = False) -> Column:
    """Matches of ``pattern`` as structs (start, end, value, left, right) in code points; with ``words``, left and right
    are the next words. Positions are summed in chunks, so the work is in proportion to the text."""
    # MARK is in no pattern: another control character in its place changes no match
    pieces = F.split(F.regexp_replace(F.translate(text, MARK, "\x03"), pattern, f"{MARK}$0{MARK}"), MARK)
    none = F.array().cast(f"array<{MATCH}>")

    def of(p: Column) -> Column:
        chunk = lambda c: F.slice(p, c * CHUNK + 1, CHUNK)
        numbers = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / CHUNK).cast("int"))
        size = lambda c: F.aggregate(chunk(c), F.lit(0), lambda n, x: n + F.length(x))
        starts = F.aggregate(numbers, F.array(F.lit(0)), lambda s, c: F.array_append(s, F.element_at(s, -1) + size(c)))

        def step(s: Column, piece: Column) -> Column:
            i, end = s["i"], s["at"] + F.length(piece)
            left = right = F.lit("")
            if words:
                left = F.regexp_extract(F.right(F.get(p, i - 1), F.lit(CONTEXT)), r"(\S+)\s+\S*$", 1)
                right = F.regexp_extract(F.left(F.get(p, i + 1), F.lit(CONTEXT)), r"^\S*\s+(\S+)", 1)
            new = F.struct(s["at"].alias("start"), end.alias("end"), piece.alias("value"), left.alias("left"), right.alias("right"))
            found = F.when(i % 2 == 1, F.array_append(s["found"], new)).otherwise(s["found"])
            return F.struct((i + 1).alias("i"), end.alias("at"), found.alias("found"))

        def located(starts: Column) -> Column:
            begin = lambda c: F.struct((c * CHUNK).alias("i"), F.get(starts, c).alias("at"), none.alias("found"))
            return F.flatten(F.transform(numbers, lambda c: F.aggregate(chunk(c), begin(c), step, lambda s: s["found"])))

        return F.when(F.size(p) > 1, let(starts, located)).otherwise(none)

    return let(pieces, of)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _as_kind(kind: int):
    return lambda m: F.struct(m["start"], F.lit(kind).alias("kind"), m["end"], m["value"], F.lower(m["left"]).alias("left"), F.lower(m["right"]).alias("right"))


def base_entities(text: Column) -> Column:
    """All base entities of a text as an array of (start, kind, end, value, left, right), ordered by start, then kind (its
    place in KINDS)."""
    number = lambda m: F.length(_digits(m["value"]))
    checks = (
        (EMAIL, F.contains(text, F.lit("@")), lambda m: F.lit(True)),
        (IP, text.rlike(r"[0-9]\."), lambda m: F.forall(F.split(m["value"], r"\."), lambda part: part.rlike(BYTE))),
        (CARD, text.rlike("[0-9]"), lambda m: number(m).between(14, 19) & F.call_function("luhn_check", _digits(m["value"]))),
        (PHONE, F.contains(text, F.lit("+")), lambda m: number(m).between(10, 15)),
    )
    none = F.array().cast(f"array<{ENTITY}>")
    parts = []
    for k, (pattern, worth, valid) in enumerate(checks):
        good = F.filter(_matches(text, pattern, words=True), valid)
        parts.append(F.when(worth, F.transform(good, _as_kind(k))).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, _h (hash of the text), base (spans) and near: the base entities, with their kind, and the identifier-like
    words that touch none of them, each with its neighbours."""
    rows = texts(docs).select("doc_id", "text", base_entities(F.col("text")).alias("found"))
    words = _matches(F.col("text"), IDENTIFIER, words=True)
    free = F.filter(words, lambda w: ~F.exists("found", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    fields = lambda w, left, right, kind: F.struct(w["start"], w["end"], w["value"], left.alias("left"), right.alias("right"), kind.alias("kind"))
    seeds = F.transform("found", lambda b: fields(b, b["left"], b["right"], b["kind"]))
    others = F.transform(free, lambda w: fields(w, F.lower(w["left"]), F.lower(w["right"]), F.lit(None).cast("int")))
    base = F.transform("found", lambda b: F.struct(b["start"], b["kind"], b["end"]))
    return rows.select("doc_id", F.xxhash64("text").alias("_h"), base.alias("base"), F.concat(seeds, others).alias("near"))


def pattern_graph(scanned: DataFrame) -> DataFrame:
    """side, word, value, kind: one row per pattern and distinct instance; kind is NULL unless the instance is a seed."""
    met = scanned.select(F.explode("near").alias("n")).select("n.*")
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("word")) for s in ("left", "right")))
    edges = met.select("value", "kind", F.explode(sides).alias("p")).select("p.side", "p.word", "value", "kind")
    return edges.filter("word <> ''").groupBy("side", "word", "value").agg(F.max("kind").alias("kind"))


def confident_patterns(graph: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: float = SUPPORT) -> DataFrame:
    """side, word, kind of the patterns that end above ``confidence``. Starts jobs."""
    met = graph.groupBy("side", "word").agg(F.count(F.lit(1)).alias("met"))
    seeds = graph.filter("kind IS NOT NULL").select("side", "word", "value", F.col("kind"), F.lit(1.0).alias("score"))
    open_edges = graph.filter("kind IS NULL").select("side", "word", "value")
    scored = seeds
    for k in range(rounds):
        sums = scored.groupBy("side", "word", "kind").agg(F.sum("score").alias("support"))
        patterns = sums.join(met, ["side", "word"]).withColumn("confidence", F.col("support") / (F.col("met") + SMOOTH))
        patterns = stored(patterns.filter(F.col("support") >= 1).select("side", "word", "kind", "support", "confidence"), "pii-patterns")
        if k + 1 < rounds:
            # an instance is as sure as the best pattern that meets it
            best = open_edges.join(patterns, ["side", "word"]).groupBy("value", "kind").agg(F.max("confidence").alias("score"))
            scored = seeds.unionByName(open_edges.join(best, "value").select("side", "word", "value", "kind", "score"))
    return patterns.filter((F.col("confidence") >= confidence) & (F.col("support") >= support)).select("side", "word", "kind")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    The counts and base_sha256 are those of the base entities; ``spans`` holds them and the n_found discovered ones as
    kind:start:end, by start, then kind, in code points with an exclusive end. NULL and empty texts have none (the digest is
    that of an empty string). Repeated rows are each returned; rows without doc_id are searched like any other; other
    columns are ignored. Starts jobs.
    """
    scanned = stored(scan(docs), "pii-scan")
    good = cut(confident_patterns(stored(pattern_graph(scanned), "pii-graph")), "pii-confident")
    rows = scanned
    if good.rows:
        near = scanned.select("doc_id", "_h", F.explode("near").alias("n")).select("doc_id", "_h", "n.*")
        near = near.filter(F.col("kind").isNull() & (F.length("value") >= MIN_CHARS)).drop("kind")
        # an e-mail address needs no digit; everything else does
        shaped = (F.length(_digits(F.col("value"))) >= MIN_DIGITS) | ((F.col("kind") == 0) & F.col("value").rlike(f"^(?:{SPELLED}|{SIGNED})$"))
        patterns = F.broadcast(good.df) if good.small else good.df
        hits = None
        for side in ("left", "right"):
            one = near.join(patterns.filter(F.col("side") == side).drop("side"), F.col(side) == F.col("word")).filter(shaped)
            one = one.select("doc_id", "_h", F.struct("start", "kind", "end").alias("span"))
            hits = one if hits is None else hits.unionByName(one)
        # spans of one text
        hits = hits.groupBy("doc_id", "_h").agg(F.collect_set("span").alias("more"))
        hits = hits.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_g"), "more")
        rows = scanned.join(hits, scanned["doc_id"].eqNullSafe(hits["_d"]) & (scanned["_h"] == hits["_g"]), "left")
    else:
        rows = rows.withColumn("more", F.lit(None).cast(f"array<{SPAN}>"))
    more = F.coalesce("more", F.array().cast(f"array<{SPAN}>"))
    count = lambda k: F.size(F.filter("base", lambda b: b["kind"] == k)).cast("bigint")
    return rows.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", more))).alias("spans"), F.size(more).cast("bigint").alias("n_found"),
    )
