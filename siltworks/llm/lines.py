"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Every distinct line is cut into ``edits + 1`` segments. Whatever ``edits`` edits do, one segment of the shorter line is
left intact in the longer one, near its place: so each line probes, for every length from its own down to
``edits`` less and every segment, the few substrings that can be that segment (position-aware from both ends), in an
index of (length, segment number, segment). What meets there is verified by a banded bit-parallel edit
distance. Lines that are linked, directly or over others, form a class; the first line of a class stays.

At scale: the text is shuffled once, to fold equal lines (before the shuffle in part, so a line that a third of all
documents share is one row). Index and probes are 25-byte rows of an equi-join, which AQE may split. Only lines that met a
partner are read again for verification. Occurrences travel as (document, line number, 128-bit key).

A segment that very many lines have would write all their pairs. With one edit, the lines that meet in such a segment
are linked by pattern instead, without pairs: two of them are one substitution apart if they are equal but for one
position, and one insertion apart if one is the other without a character. That takes rows in proportion to their
characters and gives the same links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltworks.llm.common import let, stored, texts
from siltworks.llm.components import components
from siltworks.sources.scratch import Stored, cut

EDITS = 1
MIN_CHARS = 20
BLANKS = r"[\x20\x09\x0B-\x0D]+"
KEY = ["a", "b"]
# Lines of one length that may have a segment in common before they are linked by pattern (with one edit only),
# and the length up to which they are: a pattern for each character takes time in the square of the length.
DENSE = 64
LONGEST = 2048


def split_lines(text: Column) -> Column:
    """The lines of a text as they are compared: runs of blanks are one space, none at the ends."""
    return F.transform(F.split(F.regexp_replace(text, BLANKS, " "), "\n"), lambda x: F.trim(x))


def line_keys(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(F.lit(0), line).alias("a"), F.xxhash64(F.lit(1), line).alias("b")]


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, line_no (from 0), line of every line of at least ``min_chars`` characters."""
    found = texts(docs).select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
    return found.filter(F.length("line") >= min_chars)


def _segments(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """(start from 1, length) of each of ``edits + 1`` segments of a line of ``length``; later ones are the longer ones."""
    parts = edits + 1
    short = F.floor(length / parts).cast("int")
    longer = length - short * parts  # so many at the end have one more
    out = []
    for i in range(parts):
        extra = F.greatest(F.lit(0), F.lit(i - parts) + longer)
        out.append((F.lit(i) * short + extra + 1, short + F.when(F.lit(parts - i) <= longer, 1).otherwise(0)))
    return out


def _piece(length: Column, number: int, line: Column, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(number), F.substring(line, start, size))


def index_and_probes(distinct: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """Index rows (piece, a, b) and probe rows (piece, a, b, less) of distinct lines; less: how much shorter the partner is."""
    line, length = F.col("line"), F.col("length")
    index = [_piece(length, i, line, start, size) for i, (start, size) in enumerate(_segments(length, edits))]
    probes = []
    for less in range(edits + 1):
        target = length - less
        for i, (start, size) in enumerate(_segments(target, edits)):
            # edits before the segment move it by at most i places, those behind it by the rest
            low = max(-i, less - (edits - i))
            high = min(i, less + (edits - i))
            probes += [F.struct(_piece(target, i, line, start + o, size).alias("piece"), F.lit(less).cast("byte").alias("less")) for o in range(low, high + 1)]
    rows = distinct.withColumn("length", F.length("line"))
    found = rows.select(*KEY, F.explode(F.array(*probes)).alias("x")).select("x.piece", *KEY, "x.less")
    return rows.select(F.explode(F.array(*index)).alias("piece"), *KEY), found


def _common(left: Column, right: Column, end) -> Column:
    """Number of characters at one end (``end``: F.left or F.right) in which two strings agree, by doubling steps."""
    most = F.least(F.length(left), F.length(right))
    steps = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    same = lambda n: end(left, n) == end(right, n)
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= most) & same(n + step), n + step).otherwise(n))


def unlike_part(left: Column, right: Column, margin: int) -> Column:
    """Struct (x, y): both strings without what they share at either end but for ``margin`` characters; their edit
    distance is the same."""

    def shorter(p: Column, end, size) -> Column:
        kept = lambda n: F.struct(size(p["x"], n).alias("x"), size(p["y"], n).alias("y"))
        return let(F.greatest(_common(p["x"], p["y"], end) - margin, F.lit(0)), kept)

    headless = let(F.struct(left.alias("x"), right.alias("y")), lambda p: shorter(p, F.left, lambda x, n: F.substring(x, n + 1, F.length(x))))
    return let(headless, lambda p: shorter(p, F.right, lambda x, n: F.left(x, F.length(x) - n)))


def band_distance(left: Column, right: Column, edits: int) -> Column:
    """Edit distance of two strings if it is at most ``edits``, else a larger number.

    One machine word holds the differences of a column of the edit matrix within the band of ``2 * edits + 1``
    cells around the diagonal; a step per character of the shorter string moves it on by a few bit operations.
    ``edits`` is at most 20; both strings need at least ``edits`` characters.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    # rows are the characters of the longer string
    swap = F.length(left) < F.length(right)
    long = lambda x: F.lit(x).cast("bigint")
    flip = lambda x: x.bitwiseXOR(long(full))

    def bits(given: Column, i: Column) -> Column:
        out = long(0)
        for k in range(width):
            same = F.get(given["rows"], i + (k - edits)) == F.get(given["steps"], i)
            out = out.bitwiseOR(F.when(same, long(1 << k)).otherwise(long(0)))
        return out

    def step(given: Column, s: Column, i: Column) -> Column:
        def matched(x: Column) -> Column:
            vp = s["vp"]
            return let((x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(s["vn"]).bitwiseAND(long(full)), diagonal)

        def diagonal(d0: Column) -> Column:
            return let(F.struct(d0.alias("d0"), s["vn"].bitwiseOR(flip(d0.bitwiseOR(s["vp"]))).alias("hp"), d0.bitwiseAND(s["vp"]).alias("hn"), F.shiftright(d0, 1).alias("down")), moved)

        def moved(v: Column) -> Column:
            # along the lower edge of the band until the last row, then along that row
            at = F.call_function("shiftleft", long(1), (given["m"] - i + (edits - 1)).cast("int"))
            on_edge = F.when(v["d0"].bitwiseAND(long(1 << (width - 1))) == 0, 1).otherwise(0)
            on_row = F.when(v["hp"].bitwiseAND(at) != 0, 1).when(v["hn"].bitwiseAND(at) != 0, -1).otherwise(0)
            return F.struct(
                v["hn"].bitwiseOR(flip(v["down"].bitwiseOR(v["hp"]))).alias("vp"), v["down"].bitwiseAND(v["hp"]).alias("vn"),
                (s["distance"] + F.when(i < given["m"] - edits, on_edge).otherwise(on_row)).alias("distance"),
            )

        # beyond that distance the last row cannot bring it back to ``edits``
        lost = (i < given["m"] - edits) & (s["distance"] > given["lost"])
        return F.when(lost, s).otherwise(let(bits(given, i), matched))

    def walk(given: Column) -> Column:
        start = F.struct(long(full & ~((1 << edits) - 1)).alias("vp"), long(0).alias("vn"), F.lit(edits).alias("distance"))
        way = F.sequence(F.lit(0), given["n"] - 1)
        found = F.aggregate(way, start, lambda s, i: step(given, s, i), lambda s: s["distance"])
        return F.when(given["m"] - given["n"] > edits, F.lit(edits + 1)).otherwise(found)

    m, n = F.greatest(F.length(left), F.length(right)), F.least(F.length(left), F.length(right))
    given = F.struct(
        F.split(F.when(swap, right).otherwise(left), "").alias("rows"), F.split(F.when(swap, left).otherwise(right), "").alias("steps"),
        m.alias("m"), n.alias("n"), (n - m + 2 * edits).alias("lost"),
    )
    return let(given, walk)


def _with_line(pairs: DataFrame, lines: DataFrame, side: str) -> DataFrame:
    return pairs.join(lines.select(F.col("a").alias(f"{side}a"), F.col("b").alias(f"{side}b"), F.col("line").alias(f"{side}_line")), [f"{side}a", f"{side}b"])


def _candidates(distinct: DataFrame, edits: int, dense: int) -> Stored:
    """Pairs (xa, xb, ya, yb) that meet in a piece, and rows (xa, xb, NULL, NULL) for lines that meet in a dense one."""
    index, probes = index_and_probes(distinct, edits)
    nothing, none = F.lit(None).cast("bigint"), F.lit(0).cast("byte")
    crowded = None
    if edits == 1:
        # no filter by length, and all columns of the probes: one shuffle of lines, index and probes serves all
        length = F.length("line")
        pieces = F.array(*(F.when(length <= LONGEST, _piece(length, i, F.col("line"), start, size)) for i, (start, size) in enumerate(_segments(length, edits))))
        full = distinct.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count("piece").alias("n")).filter(F.col("n") > dense).select("piece")
        sides = [index.withColumn("less", none), probes]
        inside = [side.join(full, "piece", "left_semi").select(F.col("a").alias("xa"), F.col("b").alias("xb"), nothing.alias("ya"), nothing.alias("yb"), "less") for side in sides]
        crowded = inside[0].union(inside[1]).distinct()
        index = index.join(full, "piece", "left_anti")
    x = index.select("piece", F.col("a").alias("xa"), F.col("b").alias("xb"))
    y = probes.select("piece", F.col("a").alias("ya"), F.col("b").alias("yb"), "less")
    ordered = (F.col("less") > 0) | (F.col("xa") < F.col("ya")) | ((F.col("xa") == F.col("ya")) & (F.col("xb") < F.col("yb")))
    met = x.join(y, "piece").filter(ordered).select("xa", "xb", "ya", "yb").distinct().withColumn("less", none)
    return cut(met if crowded is None else met.union(crowded), "line-candidates")


def pattern_links(lines: DataFrame) -> DataFrame:
    """Links between distinct ``lines`` (a, b, line) that are one edit apart, without pairs of those one substitution apart.

    Rows (xa, xb, ya, yb, nx, ny): x and y are in one class, and the row stands for nx links of x and ny of y. Lines that are equal
    but for one position each point at the first of them; there are no more of them than characters of the alphabet.
    """
    length = F.length("line")
    rest = [F.left("line", F.col("i") - 1), F.substring("line", F.col("i") + 1, length)]
    at = lines.select(*KEY, "line", F.explode(F.sequence(F.lit(1), length)).alias("i"))
    whole = Window.partitionBy("p", "q")
    pattern = [F.xxhash64(F.lit(seed), length, "i", *rest).alias(name) for seed, name in ((2, "p"), (3, "q"))]
    alike = at.select(*KEY, *pattern).withColumns({"n": F.count(F.lit(1)).over(whole), "first": F.min(F.struct(*KEY)).over(whole)}).filter("n > 1")
    swapped = alike.select(
        F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("first.a").alias("ya"), F.col("first.b").alias("yb"),
        (F.col("n") - 1).alias("nx"), F.lit(0).cast("bigint").alias("ny"),
    )
    # a run of equal characters gives one shorter line
    last = F.substring("line", F.col("i"), F.lit(1)) != F.substring("line", F.col("i") + 1, F.lit(1))
    shorter = at.filter(last).select(*KEY, F.concat(*rest).alias("short")).select(F.col("a").alias("ya"), F.col("b").alias("yb"), *line_keys(F.col("short")))
    one = F.lit(1).cast("bigint")
    grown = lines.select(*KEY).join(shorter, KEY).select(F.col("a").alias("xa"), F.col("b").alias("xb"), "ya", "yb", one.alias("nx"), one.alias("ny"))
    return swapped.union(grown)


def line_links(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, dense: int = DENSE) -> Stored:
    """The links of all different lines within ``edits`` edits, as keys (xa, xb, ya, yb) with (nx, ny). Starts jobs.

    A row says that x and y are in one class, and stands for nx links of x and ny links of y; summed over all rows these
    are the links of each line. Most rows are one pair (1, 1). With one edit, lines that meet more than ``dense`` lines of one
    length in a segment are linked by ``pattern_links``.
    """
    if not 0 <= edits <= 20 or min_chars < 2 * edits + 2:
        raise ValueError("edits must be 0 to 20, and lines at least 2 * edits + 2 characters long")
    lines = occurrences(docs, min_chars).select(*line_keys(F.col("line")), "line")
    met = _candidates(lines.distinct(), edits, dense)
    crowded = cut(met.df.filter(F.col("ya").isNull()).select(F.col("xa").alias("a"), F.col("xb").alias("b")).distinct(), "crowded-lines")
    by_pattern = None
    if crowded.rows:
        keys = F.broadcast(crowded.df) if crowded.small else crowded.df
        both = met.df.filter(F.col("ya").isNotNull())
        for side in ("x", "y"):
            marks = keys.select(F.col("a").alias(f"{side}a"), F.col("b").alias(f"{side}b"), F.lit(True).alias(f"{side}_in"))
            both = both.join(marks, [f"{side}a", f"{side}b"], "left")
        # two crowded lines are linked by pattern
        met = cut(both.filter(F.col("x_in").isNull() | F.col("y_in").isNull()).select("xa", "xb", "ya", "yb"), "line-candidates")
        by_pattern = pattern_links(stored(lines.join(keys, KEY, "left_semi").distinct(), "crowded-texts"))
    wanted = met.df.select(F.col("xa").alias("a"), F.col("xb").alias("b")).union(met.df.select("ya", "yb")).distinct()
    partners = lines.join(F.broadcast(wanted) if met.small else wanted, KEY, "left_semi").distinct()
    pairs = _with_line(_with_line(met.df, partners, "x"), partners, "y")
    parts = unlike_part(F.col("x_line"), F.col("y_line"), edits + 1)
    near = pairs.filter(let(parts, lambda p: band_distance(p["x"], p["y"], edits)) <= edits)
    one = F.lit(1).cast("bigint")
    near = near.select("xa", "xb", "ya", "yb", one.alias("nx"), one.alias("ny"))
    return cut(near if by_pattern is None else near.union(by_pattern), "line-links")


def line_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, dense: int = DENSE) -> DataFrame:
    """One row per line of at least ``min_chars`` characters: doc_id, line_no, class_doc, class_line, n_links, kept.

    Lines are compared with runs of blanks as one space and none at the ends. Equal lines and lines within ``edits`` edits
    are linked; (class_doc, class_line) is the first occurrence, by doc_id and line number, of what a line can reach;
    n_links counts the different lines it is linked to directly. kept: the line is that first occurrence. Shorter lines,
    NULL and empty texts give no row. A document that is repeated has its lines in each copy, all with the same marks.
    Lines without doc_id come after all others; a class of only such lines has a NULL class_doc and keeps all of them.
    ``dense`` changes how links are found, never the result. Starts jobs.
    """
    found = line_links(docs, edits, min_chars, dense)
    ends = found.df.select(F.col("xa").alias("a"), F.col("xb").alias("b"), F.col("nx").alias("n")).union(found.df.select("ya", "yb", "ny"))
    nodes = cut(ends.groupBy(*KEY).agg(F.sum("n").alias("n_links")).withColumn("node", F.monotonically_increasing_id()), "line-nodes")
    x = nodes.df.select(F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("node").alias("x"))
    y = nodes.df.select(F.col("a").alias("ya"), F.col("b").alias("yb"), F.col("node").alias("y"))
    roots = components(found.df.join(x, ["xa", "xb"]).join(y, ["ya", "yb"]).select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = nodes.df.join(roots, "node").select(*KEY, "n_links", F.col("root"))
    at = nodes.df.select(F.col("node").alias("root"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    named = cut(named.join(at, "root").select(*KEY, "n_links", "ra", "rb"), "line-roots")
    lines = occurrences(docs, min_chars).select("doc_id", "line_no", *line_keys(F.col("line")))
    lines = lines.join(F.broadcast(named.df) if named.small else named.df, KEY, "left").select(
        "doc_id", "line_no", F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    lines = stored(lines, "line-occurrences")
    last = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    first = (
        lines.groupBy(*KEY, "doc_id").agg(F.min("line_no").alias("line_no"))
        .groupBy(*KEY).agg(F.min("doc_id").alias("class_doc"), F.min_by("line_no", last).alias("class_line"))
    )
    kept = F.col("class_doc").isNull() | (F.coalesce(F.col("doc_id") == F.col("class_doc"), F.lit(False)) & (F.col("line_no") == F.col("class_line")))
    return lines.join(first, KEY).select("doc_id", "line_no", "class_doc", "class_line", "n_links", kept.alias("kept"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs``, all columns and rows, with every line taken out of ``text`` that is not the first of its class.

    Lines that stay are left as they are, and so are NULL texts and the texts of rows without doc_id. Starts jobs.
    """
    gone = line_classes(docs, edits, min_chars).filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", "line_no").distinct()
    names = docs.columns
    # line numbers of one document
    gone = gone.groupBy("doc_id").agg(F.collect_list("line_no").alias("gone")).select(F.struct("doc_id", "gone").alias("_gone"))
    both = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("_row"))
    both = both.join(gone, F.col("_row.doc_id").cast("bigint") == F.col("_gone.doc_id"), "left")
    rest = F.filter(F.split(F.col("_row.text"), "\n"), lambda x, i: ~F.array_contains(F.col("_gone.gone"), i))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(rest, "\n"))
    return both.select(*((text if n == "text" else F.col("_row").getField(n)).alias(n) for n in names))
