"""Line deduplication by a segment-partition edit join, in DataFrame functions alone.

Lines of at least ``min_chars`` code points take part. Two lines are near if at most so many insertions, deletions or
substitutions turn one into the other as the shorter one's length allows: one number, or steps of (length from, edits).
A line that allows e edits is cut into e + 1 segments. Going from the left, some segment i is unchanged in the near line
with exactly i edits before it, so it lies there at most i places away, and what follows segment e is equal too. Each distinct line is indexed by its segments
under (band of lengths, segment number, segment); the bands are the steps of three binary digits, whose lowest length
fixes the cuts. As the longer one of a pair a line probes, in its own band and those that fewer code points reach, the few
substrings that can match there. Keys of more than one line make pairs if lengths and letter counts are close enough;
banded bit-parallel edit distance, one column of ``2 * edits + 1`` cells in the bits of a number at a time, decides.

Keys go through one exchange, which drops the many that only one line has; the lines that are left are read again, for
their texts and letter counts. A key of more than ``crowd`` rows is dealt out again by exact length and by buckets of letter
counts, the prober naming every bucket in reach, so no pair is lost and lines that share a long beginning do not all meet.

Of equal lines the first occurrence (by doc_id, then place) stays; a line goes if an earlier distinct line is near it.
Equal lines are made one before segments are dealt out, so a line that fills a third of the corpus is one row there.

Null text stays null; empty texts, empty lines and short lines stay as they are (with ``every_repeat`` exact repetitions
of short lines go too). Very long lines and texts are used whole. An empty table gives an empty table. Rows equal in
doc_id and text are one document, each of which is returned with the same lines gone; rows that share a doc_id but not the
text are documents of their own, ordered by a hash of the text. Rows without doc_id pass unchanged and are not looked at.
Extra columns pass by; where one has the name of a count column, that column gets underscores behind its name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, small

#: Edits that a line allows from a length on, as the queries use them.
BY_LENGTH = ((20, 1), (256, 2), (512, 3), (1024, 4))
#: Where no rule is given: a tenth of the length, MOST at most.
MOST = 20
TENTH = tuple((10 * e, e) for e in range(2, MOST + 1))
#: Letters whose counts are compared before texts are: an edit changes two of them by one at most.
ALPHABET = "etn abcdfghilmoprsuvy,.0123456789"
#: How many of them, from the first, deal out crowded keys.
DEALT = 3


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def within_edits(x: Column, y: Column, most: int) -> Column:
    """Whether two strings are at most ``most`` edits apart."""
    return F.coalesce(banded_distance(x, y, most) <= most, F.lit(False))


def banded_distance(x: Column, y: Column, most: int) -> Column:
    """Edit distance where it is at most ``most`` (else more than that, or null), by banded bit-parallel dynamic programming.

    Bit b of the numbers stands for the row ``j - most + b`` of column j: whether the cell is one more (vp) or one less (vn)
    than the cell above it. d is the distance on the main diagonal.
    """
    band = 2 * most + 1
    ones = (1 << band) - 1
    bit = [F.lit(1 << b).cast("long") for b in range(band)]
    full, top = F.lit(ones).cast("long"), bit[-1]

    def flip(c: Column) -> Column:
        return full.bitwiseXOR(c.bitwiseAND(full))

    def run(long: Column, short: Column) -> Column:
        def column(state: Column, j: Column) -> Column:
            def with_match(match: Column) -> Column:
                def with_sides(s: Column) -> Column:
                    def with_zero(zero: Column) -> Column:  # cells equal to their upper left neighbour
                        def with_rows(h: Column) -> Column:
                            up = F.shiftleft(h["hp"], 1).bitwiseOR(bit[0]).bitwiseAND(full)
                            down = F.shiftleft(h["hn"], 1).bitwiseAND(full)
                            return F.struct(
                                down.bitwiseOR(flip(zero.bitwiseOR(up))).alias("vp"),
                                zero.bitwiseAND(up).alias("vn"),
                                (state["d"] + F.when(zero.bitwiseAND(bit[most]) == 0, 1).otherwise(0)).alias("d"),
                            )

                        return let(F.struct(s["vn"].bitwiseOR(flip(s["vp"].bitwiseOR(zero))).alias("hp"), s["vp"].bitwiseAND(zero).alias("hn")), with_rows)

                    eq = match.bitwiseOR(s["vn"])
                    return let((s["vp"] + eq.bitwiseAND(s["vp"])).bitwiseXOR(s["vp"]).bitwiseOR(eq).bitwiseAND(full), with_zero)

                return let(F.struct(F.shiftright(state["vp"], 1).bitwiseOR(top).alias("vp"), F.shiftright(state["vn"], 1).alias("vn")), with_sides)

            here = F.get(short, j)
            match = sum((F.when(F.get(long, j + (b - most)) == here, bit[b]).otherwise(F.lit(0).cast("long")) for b in range(band)), F.lit(0).cast("long"))
            return let(match, with_match)

        first = F.struct(F.lit(ones >> (most + 1) << (most + 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(0).alias("d"))
        steps = F.when(F.size(short) > 0, F.sequence(F.lit(0), F.size(short) - 1)).otherwise(F.array().cast("array<int>"))

        def distance(s: Column) -> Column:
            """Down the last column from the main diagonal to the longer string's end."""
            extra = F.size(long) - F.size(short)
            out = s["d"]
            for k in range(1, most + 1):
                sign = F.when(s["vp"].bitwiseAND(bit[most + k]) != 0, 1).otherwise(0) - F.when(s["vn"].bitwiseAND(bit[most + k]) != 0, 1).otherwise(0)
                out = out + F.when(extra >= k, sign).otherwise(0)
            return out

        return F.aggregate(steps, first, column, distance)

    a, b = F.split(x, ""), F.split(y, "")
    close = F.abs(F.length(x) - F.length(y)) <= most
    # an empty string splits into one empty piece
    a, b = F.filter(a, lambda c: c != ""), F.filter(b, lambda c: c != "")
    pair = F.when(F.length(x) >= F.length(y), F.struct(a.alias("long"), b.alias("short"))).otherwise(F.struct(b.alias("long"), a.alias("short")))
    return F.when(close, let(pair, lambda p: run(p["long"], p["short"])))


def exploded(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, th (hash of the text), pos, line of every line that takes part."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.length("line") >= min_chars)


def place() -> Column:
    """One number for (doc_id, th, pos) that orders as they do, as far as 30 bits of th tell."""
    behind = F.pmod("th", F.lit(10**9)) * F.lit(1 << 31) + F.col("pos")
    return (F.col("doc_id").cast("decimal(19,0)") * F.lit((1 << 31) * 10**9).cast("decimal(19,0)") + behind.cast("decimal(19,0)")).cast("decimal(38,0)")


def hashes() -> tuple[Column, Column]:
    """What stands for a line: 128 bits of hash."""
    return F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("again"), F.col("line")).alias("h2")


def allowed(n: Column, steps) -> Column:
    """Edits that a line of n code points allows; none below the first step."""
    out = F.lit(0)
    for length, edits in steps:
        out = F.when(n >= length, F.lit(edits)).otherwise(out)
    return out


def band(n: Column, steps) -> Column:
    """The lowest length of n's band: n with all but its first three binary digits zero, but no band reaches over a step."""
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(n + 0.5)).cast("int") - 2)).cast("int")
    low = F.lit(0)
    for length, _ in steps:
        low = F.when(n >= length, F.lit(length)).otherwise(low)
    return F.greatest(low, (F.floor(n / unit) * unit).cast("int"))


def bands_below(steps) -> int:
    """How many bands of fewer code points the lines of any band reach at most (bands of 32 times the edits are wide)."""

    def edits(n: int) -> int:
        return max((e for length, e in steps if n >= length), default=0)

    def low(n: int) -> int:
        unit = 1 << max(0, n.bit_length() - 3)
        return max(max((length for length, _ in steps if n >= length), default=0), n // unit * unit)

    lengths = range(steps[0][0], 32 * (steps[-1][1] + 1) + steps[-1][0])
    return max(len({low(n - d) for d in range(edits(n) + 1) if n - d >= steps[0][0] and d <= edits(n - d)}) for n in lengths) - 1


def places(edits: int) -> list[tuple[int, int]]:
    """(segment, offset): where a longer line of so many edits can hold a segment of the shorter one."""
    return [(i, off) for i in range(edits + 1) for off in range(-min(i, edits - i), i + 1)]


def keyed(classes: DataFrame, steps) -> DataFrame:
    """A row (k, own) for every segment and probe of each distinct line, beside what is known of the line, and ``head``, a
    hash of its first segment, behind that one; and a row with ``at`` for each line that occurs again. Plain columns between two explodes, so that all is compiled code."""
    n, line, low = F.col("n"), F.col("line"), F.col("low")
    sized = classes.withColumn("n", F.length("line")).select("line", "n", *hashes(), F.when(F.col("c") > 1, F.col("at")).alias("at"), band(n, steps).alias("low0"))
    reached = [F.struct(F.col("low0").alias("low"), n.alias("most"))]  # with the greatest length that a shorter line there has
    for i in range(1, bands_below(steps) + 1):
        above = F.col(f"low{i - 1}")
        sized = sized.withColumn(f"low{i}", band(above - 1, steps))
        reached.append(F.struct(F.col(f"low{i}").alias("low"), (above - 1).alias("most")))
    banded = sized.select("line", "n", "h1", "h2", "at", "low0", F.inline(F.array(*reached))).withColumn("e", allowed(low, steps))
    banded = banded.where((low == F.col("low0")) | ((low >= steps[0][0]) & (n - F.col("most") <= F.col("e"))))
    spots = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("off")))
    for kind in sorted({e for _, e in steps}):
        spots = F.when(F.col("e") == kind, F.array(*(F.struct(F.lit(i).alias("i"), F.lit(off).alias("off")) for i, off in [(-1, 0), *places(kind)]))).otherwise(spots)
    spots = F.when(low >= steps[0][0], spots).otherwise(F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("off"))))
    size = F.floor(low / (F.col("e") + 1)).cast("int")
    dealt = banded.withColumn("size", size).select("*", F.inline(spots)).withColumn("begin", F.col("i") * F.col("size") + F.col("off"))
    mine = low == F.col("low0")
    again = F.col("i") < 0
    dealt = dealt.where((again & mine & F.col("at").isNotNull()) | (~again & (F.col("begin") + F.col("size") <= n)))
    # behind the last segment nothing differs, as all edits are before it
    until = F.when(F.col("i") == F.col("e"), n - F.col("begin")).otherwise(F.col("size"))
    k = F.when(again, F.xxhash64("h1", "h2")).otherwise(F.xxhash64("low", "i", F.substring(line, F.col("begin") + 1, until)))
    head = F.when(F.col("i") > 0, F.xxhash64(F.substring(line, 1, F.col("size"))))
    return dealt.select(k.alias("k"), head.alias("head"), (~again & mine & (F.col("off") == 0)).alias("own"), "h1", "h2", "n", F.when(again, F.col("at")).alias("at"))


def with_each(ways: Column, ends: Column) -> Column:
    """Every array of ``ways`` with every one of ``ends`` behind it."""
    return F.flatten(F.transform(ways, lambda w: F.transform(ends, lambda x: F.concat(w, F.array(x)))))


def near_pairs(meet: DataFrame, steps, crowd: int) -> DataFrame:
    """(a1, a2, b1, b2): hashes of distinct lines that share a key and whose lengths and letter counts are close enough."""
    calm, hot = meet.where(F.col("c") <= crowd), meet.where(F.col("c") > crowd)
    numbers = [F.get("counts", k) for k in range(DEALT)]

    def bucket(value: Column, e: Column) -> Column:
        return F.floor(value / (8 * e + 1)).cast("long")

    n, e, m = F.col("n"), allowed(F.col("n"), steps), F.col("m")
    mine = F.xxhash64("k", n, *(bucket(c, e) for c in numbers))
    reach = F.explode(F.filter(F.sequence(n - e, n), lambda m: (m >= steps[0][0]) & (n - m <= allowed(m, steps))))
    em, ways = allowed(m, steps), F.array(F.array().cast("array<bigint>"))
    for c in numbers:
        ways = with_each(ways, F.array_distinct(F.array(bucket(F.greatest(F.lit(0), c - em), em), bucket(c + em, em))))
    spread = hot.select("*", reach.alias("m")).select("*", F.explode(ways).alias("w")).withColumn("j", F.xxhash64("k", "m", *(F.get("w", k) for k in range(DEALT))))
    cols = ["j", "head", "h1", "h2", "n", "counts"]
    x = calm.where("own").withColumn("j", F.col("k")).select(cols).union(hot.where("own").withColumn("j", mine).select(cols))
    y = calm.withColumn("j", F.col("k")).select(cols).union(spread.select(cols))
    x = x.select(F.col("j").alias("jx"), F.col("head").alias("headx"), F.col("h1").alias("x1"), F.col("h2").alias("x2"), F.col("n").alias("nx"), F.col("counts").alias("cx"))
    most = allowed(F.col("nx"), steps)
    apart = F.aggregate(F.zip_with("counts", "cx", lambda p, q: F.abs(p - q)), F.lit(0), lambda p, q: p + q)
    # lines with equal first segments have met there
    fits = (F.col("headx").isNull() | (F.col("headx") != F.col("head"))) & (F.col("n") - F.col("nx")).between(0, most) & ((F.col("h1") != F.col("x1")) | (F.col("h2") != F.col("x2"))) & (apart <= 2 * most - (F.col("n") - F.col("nx")))
    a, b = F.struct(F.col("x1").alias("p"), F.col("x2").alias("q")), F.struct(F.col("h1").alias("p"), F.col("h2").alias("q"))
    found = x.join(y, (F.col("jx") == F.col("j")) & fits).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return found.select(F.col("a.p").alias("a1"), F.col("a.q").alias("a2"), F.col("b.p").alias("b1"), F.col("b.q").alias("b2")).distinct()


def near(x: Column, y: Column, steps) -> Column:
    """Whether two lines are as near as the shorter one's length asks."""
    e = allowed(F.least(F.length(x), F.length(y)), steps)
    kinds = sorted({k for _, k in steps})
    if len(kinds) > 6:  # one wide band
        return F.coalesce(banded_distance(x, y, kinds[-1]) <= e, F.lit(False))
    out = F.lit(False)
    for k in kinds:
        out = F.when(e == k, within_edits(x, y, k)).otherwise(out)
    return out


def dropped_lines(docs: DataFrame, max_edits=1, min_chars: int = 20, most_broadcast: int = 200_000, every_repeat: bool = False, crowd: int = 2000) -> DataFrame:
    """doc_id, th, pos, near of every line that goes; near: not a repetition, but near an earlier line.

    ``max_edits`` is a number, or steps of (length from, edits) as ``BY_LENGTH`` (edits must not fall); None stands for a
    tenth of the length. With ``every_repeat`` exact repetitions of all lines that are not empty go; ``min_chars`` is then
    for near lines only.
    """
    steps = TENTH if max_edits is None else ((min_chars, max_edits),) if isinstance(max_edits, int) else tuple(max_edits)
    if any(length < edits + 1 for length, edits in steps) or steps[0][0] < min_chars:
        raise ValueError("lines must be longer than the edits they allow, and of min_chars at least")
    lines = exploded(docs, 1 if every_repeat else max(1, min_chars))
    classes = lines.groupBy("line").agg(F.min(place()).alias("at"), F.count("*").alias("c"))
    group = Window.partitionBy("k")
    many = keyed(classes, steps).select("*", F.count("*").over(group).alias("c"), (F.min("h1").over(group) != F.max("h1").over(group)).alias("several"))
    kept = small(many.where("at is not null or several"))
    meet = kept.where("several and at is null")
    ends = small(meet.select("h1", "h2").distinct())
    release(docs.sparkSession)  # the texts and segments that were dealt out
    needed = F.broadcast(ends) if ends.count() <= most_broadcast else ends
    found = exploded(docs, min_chars).select("*", *hashes()).join(needed, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "line").agg(F.min(place()).alias("at"))
    texts = small(found.withColumn("counts", F.array(*(F.length("line") - F.length(F.replace("line", F.lit(c), F.lit(""))) for c in ALPHABET))))
    release(docs.sparkSession)
    pairs = near_pairs(meet.drop("at").join(texts.select("h1", "h2", "counts"), ["h1", "h2"]), steps, crowd)
    a, b = (texts.select(F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"), F.col("line").alias(t), F.col("at").alias(f"a{t}")) for s, t in (("a", "x"), ("b", "y")))
    true = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).where(near(F.col("x"), F.col("y"), steps))
    later = F.col("ax") > F.col("ay")
    gone = true.select(F.when(later, F.col("a1")).otherwise(F.col("b1")).alias("h1"), F.when(later, F.col("a2")).otherwise(F.col("b2")).alias("h2"), F.lit(None).cast("decimal(38,0)").alias("at"), F.lit(True).alias("near"))
    again = kept.where("at is not null").select("h1", "h2", "at", F.lit(False).alias("near"))
    judged = small(again.union(gone).groupBy("h1", "h2").agg(F.max("at").alias("at"), F.max("near").alias("near")))
    release(docs.sparkSession)
    first = F.col("at").isNull() | (place() == F.col("at"))  # a line that does not occur again has no place there
    return lines.select("doc_id", "th", "pos", *hashes()).join(judged, ["h1", "h2"]).where(F.col("near") | ~first).select("doc_id", "th", "pos", (F.col("near") & first).alias("near")).distinct()


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores behind those that a column has already (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def deduplicated(df: DataFrame, max_edits=1, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", every_repeat: bool = False) -> DataFrame:
    """All rows and columns, the text without its dropped lines, and the columns lines_repeated and lines_near (counts)."""
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines = dropped_lines(narrow, max_edits, min_chars, every_repeat=every_repeat)
    mark = uuid.uuid4().hex[:8]
    key, th, at, n_near = (f"{x}_{mark}" for x in ("id", "th", "at", "near"))
    by_doc = lines.groupBy(F.col("doc_id").alias(key), F.col("th").alias(th)).agg(F.array_sort(F.collect_list("pos")).alias(at), F.sum(F.col("near").cast("int")).alias(n_near))
    out = df.join(by_doc, (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(th)), "left")
    pieces = F.split(F.col(text_col), "\n")
    begins = F.concat(F.array(F.lit(0)), F.transform(at, lambda p: p + 1))
    ends = F.concat(F.col(at), F.array(F.size(pieces)))
    rest = let(pieces, lambda p: F.flatten(F.zip_with(begins, ends, lambda s, e: F.slice(p, s + 1, e - s))))
    text = F.when(F.col(key).isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
    near_lines = F.coalesce(F.col(n_near), F.lit(0)).cast("long")
    repeated, nearly = free_names(df.columns, "lines_repeated", "lines_near")
    return out.withColumns({text_col: text, nearly: near_lines, repeated: F.coalesce(F.size(at), F.lit(0)).cast("long") - near_lines}).drop(key, th, at, n_near)
