"""N-gram Jaccard join by prefix filters under several global orders.

A document is the set of its hashed word n-grams (words: runs of anything but ASCII white space, A-Z lower-cased; with
fewer words than n the whole sequence is one n-gram; without words the set is empty and linked with nothing). Two
documents link when ``100 * intersection >= percent * union``. Linked sets must share an n-gram among the first
``size - ceil(percent * size / 100) + 1`` of each under *any* order of all n-grams, so candidates must pass under three.
All orders put rare n-grams first, by a fixed-size sketch of document frequencies (4M counters), and differ in how they
order n-grams of like frequency.

1. Equal sets are one class, kept by its smallest doc_id.
2. Classes that share a prefix n-gram under the first order meet in a join whose condition also holds their sizes and a
   parity bitmap (1,024 bits) against the threshold: the bits that differ bound the symmetric difference from below. Before
   that, 64 bands of sizes for each n-gram tell which classes meet none of a size that could link; those need no row there.
3. The other orders' prefixes are intersected; what is left is verified on the whole sets.
4. Groups of many near copies would meet in all pairs. Where an n-gram is in more than ``crowd`` prefixes each class is
   therefore first verified against one pivot, the class there with the fewest prefix n-grams of its own; afterwards only
   classes of different components meet. No link between different components is lost.
5. Components by alternating large-star and small-star steps over the links.

Null text counts as empty. Very long texts are used whole. Where doc_ids repeat or are null, each different pair of id and
text is numbered first and linked under its number. ``link_documents`` then takes rows that repeat a doc_id as one document
whose links join, and returns each of them; rows without doc_id link nothing and have component null. ``keep_one`` goes by
the text alone: of rows linked with one another one stays, and no text goes that is not linked with one that stays. Texts
without words are linked with nothing and stay. Empty tables give no rows. Other columns pass by.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_text, map_rows, release, small

SKETCH_BITS, CHUNK_BITS, WORDS64 = 22, 16, 16
SALTS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


GAP = re.compile(rb"[\x20\x09-\x0d]")
#: Fixed bytes: white space, and A-Z on a-z.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.arange(256, dtype=np.uint64)
_BYTES[65:91] += np.uint64(32)
LETTER = mix(_BYTES + np.uint64(0x5851F42D4C957F2D))
#: Words are hashed together, in blocks of texts, as differences of one polynomial's running sums; a word's place is divided
#: out by powers of the base's inverse. Longer words than LONG, where such sums are weak, are hashed one by one.
BLOCK, LONG = 1 << 15, 200
FACTOR = 0xD6E8FEB86659FD93
INVERSE = pow(FACTOR, -1, 1 << 64)


def powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWER, BACK = powers(FACTOR), powers(INVERSE)


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word (run of anything but ASCII white space, A-Z lower-cased), in the text's order."""
    import xxhash

    if len(data) > BLOCK:  # cut at the last white space in reach; a longer word stands alone
        out, at = [], 0
        while at < len(data):
            end = len(data)
            if end - at > BLOCK:
                blanks = np.flatnonzero(BLANK[np.frombuffer(data, np.uint8, BLOCK, at)])
                if len(blanks):
                    end = at + int(blanks[-1]) + 1
                else:
                    m = GAP.search(data, at + BLOCK)
                    end = m.end() if m else end
            if end - at > BLOCK:
                word = data[at:end].strip()
                out.append(np.array([xxhash.xxh3_64_intdigest(word.lower())], np.uint64))
            else:
                out.append(word_hashes(data[at:end]))
            at = end
        return np.concatenate(out)
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(BLANK[raw], prepend=True, append=True))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(LETTER[raw] * POWER[: len(raw)], out=sums[1:])
    size = end - begin
    h = mix((sums[end] - sums[begin]) * BACK[begin] + size.astype(np.uint64))
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]].lower())
    return h


class Shingler:
    """Sorted distinct n-gram hashes of a text."""

    def __init__(self, words: int):
        self.n = words

    def __call__(self, text: str | None) -> np.ndarray:
        w = word_hashes((text or "").encode())
        if not len(w):
            return np.empty(0, np.uint64)
        n = min(self.n, len(w))
        h = mix(w[: len(w) - n + 1] + np.uint64(n))
        for k in range(1, n):
            h = mix(h + w[k : len(w) - n + 1 + k])
        h.sort()
        return h[np.concatenate(([True], h[1:] != h[:-1]))]


def frequency_sketch(docs: DataFrame, words: int) -> np.ndarray:
    """Document frequencies of n-grams by 4M hashed counters, as a byte of logarithm each: 4 MB whatever the input."""

    class Count:
        def __init__(self):
            self.shingles, self.total, self.late, self.n = Shingler(words), np.zeros(1 << SKETCH_BITS, np.uint32), [], 0

        def __call__(self, text):
            self.late.append((self.shingles(text) >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32))
            self.n += len(self.late[-1])
            if self.n >= 1 << 20:
                self.add()
            return ()

        def add(self):
            if self.late:
                self.total += np.bincount(np.concatenate(self.late), minlength=len(self.total)).astype(np.uint32)
                self.late, self.n = [], 0

        def finish(self):
            self.add()
            for c, part in enumerate(self.total.reshape(-1, 1 << CHUNK_BITS)):
                if part.any():
                    yield c, zlib.compress(part.tobytes(), 1)

    class Add:
        def __init__(self):
            self.total: dict[int, np.ndarray] = {}

        def __call__(self, chunk, data):
            part = np.frombuffer(zlib.decompress(data), np.uint32)
            self.total[chunk] = self.total.get(chunk, 0) + part.astype(np.uint64)
            return ()

        def finish(self):
            for c, part in self.total.items():
                yield c, np.minimum(255, np.round(8 * np.log2(1 + part.astype(float)))).astype(np.uint8).tobytes()

    schema, ddl = pa.schema([("chunk", pa.int32()), ("data", pa.binary())]), "chunk int, data binary"
    parts = map_rows(docs.select("text"), Count, schema, ddl, 16)
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for chunk, data in map_rows(parts.repartition(1 << (SKETCH_BITS - CHUNK_BITS), "chunk"), Add, schema, ddl, 16).collect():
        out[chunk << CHUNK_BITS : (chunk + 1) << CHUNK_BITS] = np.frombuffer(data, np.uint8)
    return out


def digest_sets(docs: DataFrame, words: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """doc_id, n, key (digest of the set), prefixes under three orders, and the parity bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def start():
        shingles = Shingler(words)
        sketch = shared.value

        def each(doc_id, text):
            h = shingles(text)
            n = len(h)
            if not n:
                yield doc_id, 0, b"", [], [], [], *[0] * WORDS64
                return
            rare = sketch[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
            p = n + (-percent * n // 100) + 1
            prefixes = []
            for salt in SALTS:
                order = rare | (mix(h ^ np.uint64(salt)) >> np.uint64(8))
                prefixes.append(h[np.argpartition(order, p - 1)[:p]] if p < n else h)
            bits = np.bincount((h & np.uint64(64 * WORDS64 - 1)).astype(np.int64), minlength=64 * WORDS64) & 1
            signature = np.packbits(bits.astype(np.uint8)).view(np.int64)
            yield doc_id, n, hashlib.blake2b(h.tobytes(), digest_size=16).digest(), prefixes[0].view(np.int64), *((x >> np.uint64(32)).astype(np.uint32).view(np.int32) for x in prefixes[1:]), *signature.tolist()

        return each

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("p1", pa.list_(pa.int64())), ("p2", pa.list_(pa.int32())), ("p3", pa.list_(pa.int32())), *((f"s{k}", pa.int64()) for k in range(WORDS64))])
    ddl = "doc_id long, n long, key binary, p1 array<long>, p2 array<int>, p3 array<int>, " + ", ".join(f"s{k} long" for k in range(WORDS64))
    return map_rows(docs, start, schema, ddl, 128)


#: Sets of at most so many n-grams travel as 48 bits of each hash, larger ones as 64: two n-grams of a pair of sets are then
#: taken for one in less than one pair of 60,000, which matters only to a pair that the threshold decides by one n-gram.
MOST48 = 1 << 16


def packed(h: np.ndarray) -> bytes:
    """Sorted hashes as their first 6 bytes, or all 8; the first byte says which."""
    wide = 6 if len(h) <= MOST48 else 8
    return bytes([wide]) + h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()


def unpacked(data: bytes, wide: int) -> np.ndarray:
    """The first ``wide`` bytes of each hash."""
    out = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    out[:, :wide] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])[:, :wide]
    return out.view(">u8").ravel().astype(np.uint64)


def same_enough(x: bytes, y: bytes, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union for two packed sets."""
    wide = min(x[0], y[0])
    a, b = unpacked(x, wide), unpacked(y, wide)
    same = len(np.intersect1d(a, b, assume_unique=True)) if wide == 8 else len(np.intersect1d(a, b))
    return same * (100 + percent) >= percent * (len(a) + len(b))


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int, most_broadcast: int = 200_000) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Their ids are broadcast if they are few, else joined."""
    ids = small(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    needed = docs.join(F.broadcast(ids) if ids.count() <= most_broadcast else ids, "doc_id", "left_semi")

    def start():
        shingles = Shingler(words)

        def each(doc_id, text):
            yield doc_id, packed(shingles(text))

        return each

    def compare():
        def each(a, b, x, y):
            if same_enough(x, y, percent):
                yield a, b

        return each

    sets = map_rows(needed, start, pa.schema([("doc_id", pa.int64()), ("set", pa.binary())]), "doc_id long, set binary", 64)
    x, y = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return map_rows(both, compare, pa.schema([("a", pa.int64()), ("b", pa.int64())]), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): component is the smallest node reachable."""
    edges = small(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = small(star.distinct())


def size_band(percent: int) -> Column:
    """One bit of 64 for a set's size ``n``: sizes that can link are at most two bits apart, counted in a circle. The factor
    below 2 keeps that true whatever the rounding."""
    step = max(math.log(100 / percent), 1e-9)
    return F.expr(f"shiftleft(1L, cast(floor({1.999 / step!r}D * ln(n)) % 64 as int))")


def meets(bits: str) -> Column:
    """Whether a class of the bands ``bits`` can find another of like size among an n-gram's ``c`` classes of ``bands``: two
    of them are in one band, or a band up to two bits away is taken."""
    around = " | ".join(f"shiftleft({bits}, {k}) | shiftrightunsigned({bits}, {64 - k})" for k in (1, 2, 62, 63))
    return F.expr(f"bit_count(bands) < c or (bands & ({around})) <> 0")


def ambiguous(docs: DataFrame) -> bool:
    """Whether a doc_id is null or repeats."""
    return bool(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count())


def text_digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes: a number for each different pair of doc_id and text (its digest); and the texts under their numbers. The
    numbers are in a checkpoint, so they stay what they are."""
    nodes = cut(docs.select(F.col("doc_id").alias("id"), text_digest().alias("digest")).distinct().withColumn("node", F.monotonically_increasing_id()))
    placed = docs.withColumn("digest", text_digest()).join(nodes.withColumnRenamed("digest", "_d"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("_d")))
    return nodes, placed.select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"])


def link_documents(df: DataFrame, words: int = 3, percent: int = 90, crowd: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    docs = id_text(df, id_col, text_col)
    if not ambiguous(docs):
        return linked(docs, words, percent, crowd)
    nodes, texts = numbered(docs)
    named = nodes.where("id is not null")
    by_node = cut(linked(texts.join(named.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), words, percent, crowd).withColumnRenamed("doc_id", "node").join(named, "node"))
    # The components that share a doc_id are one: each is linked with the least of them.
    least = by_node.groupBy("id").agg(F.min("component_id").alias("b"))
    joined = components(by_node.join(least, "id").select(F.col("component_id").alias("a"), "b").distinct())
    whole = by_node.join(joined.select(F.col("node").alias("component_id"), "component"), "component_id", "left").withColumn("c", F.coalesce("component", "component_id"))
    smallest = whole.groupBy("c").agg(F.min("id").alias("component_id"))
    out = whole.select("id", "digest", "n_shingles", "c").join(smallest, "c").select("id", "digest", F.col("component_id").alias("component"))
    sizes = linked_sizes(texts, words).join(nodes, F.col("doc_id") == F.col("node")).select("id", "digest", "n_shingles")
    rows = docs.select("doc_id", text_digest().alias("_d"))
    with_size = rows.join(sizes, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_d") == F.col("digest"))).select("doc_id", "_d", "n_shingles")
    return with_size.join(out, (F.col("doc_id") == F.col("id")) & (F.col("_d") == F.col("digest")), "left").select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def linked_sizes(texts: DataFrame, words: int) -> DataFrame:
    """Size of each text's set."""

    def start():
        shingles = Shingler(words)
        return lambda doc_id, text: ((doc_id, len(shingles(text))),)

    return map_rows(texts, start, pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64())]), "doc_id long, n_shingles long")


def linked(docs: DataFrame, words: int, percent: int, crowd: int) -> DataFrame:
    """doc_id, n_shingles, component_id of documents whose doc_ids are unique and not null."""
    rows = cut(digest_sets(docs, words, percent, frequency_sketch(docs, words)))
    classes = small(rows.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep")))
    kept = rows.join(classes.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"], "left_semi")
    tokens = kept.select("doc_id", size_band(percent).alias("band"), F.explode("p1").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("c"), F.bit_or("band").alias("bands")).where("c > 1").where(meets("bands"))
    meet = cut(tokens.join(shared, "token").where(meets("band")).select("token", "doc_id", "c"))
    release(docs.sparkSession)  # prefixes that were counted and joined
    own = meet.groupBy("doc_id").agg(F.count("*").alias("common"), F.max("c").alias("most")).join(classes.withColumnRenamed("rep", "doc_id"), "doc_id")
    signatures = [f"s{k}" for k in range(WORDS64)]
    wide = rows.select("key", "doc_id", "n", F.size("p1").alias("p"), "p2", "p3", *signatures)  # p1 itself stays out of the shuffle
    about = cut(wide.join(own, ["key", "doc_id"]).select("doc_id", "n", (F.col("p") - F.col("common")).alias("alone"), "most", "p2", "p3", *signatures))
    release(docs.sparkSession)

    def alike(a: str, b: str):
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in signatures), F.lit(0))
        return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (differ * (100 + percent) <= (100 - percent) * (na + nb))

    def filtered(pairs: DataFrame) -> DataFrame:
        """Under the other two orders."""
        a, b = about.select(F.col("doc_id").alias("a"), F.col("p2").alias("a2"), F.col("p3").alias("a3")), about.select(F.col("doc_id").alias("b"), F.col("p2").alias("b2"), F.col("p3").alias("b3"))
        return pairs.join(a, "a").join(b, "b").where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b").distinct()

    links = None
    light = about.select("doc_id", "n", *signatures)
    if about.where(F.col("most") > crowd).limit(1).count():
        crowded = meet.where(F.col("c") > crowd).join(about.select("doc_id", "alone"), "doc_id")
        rank = F.struct("alone", "doc_id")
        pivots = crowded.groupBy("token").agg(F.min(rank).alias("pivot"))
        chosen = crowded.select("token", "doc_id").join(pivots, "token").groupBy("doc_id").agg(F.min("pivot").alias("pivot")).select(F.col("doc_id").alias("a"), F.col("pivot.doc_id").alias("b")).where("a <> b")
        near = chosen.join(light.alias("x"), F.col("a") == F.col("x.doc_id")).join(light.alias("y"), F.col("b") == F.col("y.doc_id")).where(alike("x", "y")).select("a", "b")
        links = small(verified(small(filtered(near)), docs, words, percent))
        release(docs.sparkSession)
        placed = components(links)
        light = light.join(placed, light.doc_id == placed.node, "left").select("doc_id", "n", *signatures, F.coalesce("component", "doc_id").alias("part"))
    else:
        light = light.withColumn("part", F.col("doc_id"))
    # n-grams whose classes are all in one component need no more pairs
    parts = light.select("doc_id", "part")
    mixed = meet.join(parts, "doc_id").groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("token")
    spread = cut(meet.select("token", "doc_id").join(mixed, "token").join(light, "doc_id"))
    x, y = spread.alias("x"), spread.alias("y")
    found = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.part") != F.col("y.part")) & alike("x", "y"))
    pairs = small(filtered(found.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()))
    more = verified(pairs, docs, words, percent)
    placed = components(links.union(more) if links is not None else more)
    release(docs.sparkSession)
    whole = classes.join(placed, classes.rep == placed.node, "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    return rows.select("doc_id", "n", "key").join(whole, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, most_broadcast: int = 200_000) -> DataFrame:
    """One row of each component, all columns as they are: that of the smallest doc_id (rows without one come last, then the
    least digest of the text decides; of rows equal in both any one). Where the ids that go are at most ``most_broadcast``
    they are broadcast, so the texts are not shuffled; else they are joined."""
    plain = id_text(docs)
    if not ambiguous(plain):
        found = linked(plain, words, percent, 32)
        drop = small(found.where("component_id <> doc_id").select("doc_id").distinct())
        return docs.join(F.broadcast(drop) if drop.count() <= most_broadcast else drop, "doc_id", "left_anti")
    nodes, texts = numbered(plain)
    found = linked(texts, words, percent, 32).withColumnRenamed("doc_id", "node").join(nodes, "node")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest", "n_shingles")).alias("x"))
    kept = cut(first.select(F.col("x.id").alias("_id"), F.col("x.digest").alias("_kept"), (F.col("x.n_shingles") > 0).alias("_once")))
    digest = F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)
    rows = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (digest == kept["_kept"]))
    once = rows.where("_once").dropDuplicates(["_id", "_kept"])
    return once.unionByName(rows.where("not _once")).select(*docs.columns)
