"""Line deduplication where keys are crowded, ids repeat and columns clash."""

import random

import pytest

from skein.llm import lines

from .test_llm import edits, frame, texts_of


def steps_of(n):
    return max((e for length, e in lines.BY_LENGTH if n >= length), default=0)


def brute_by_length(docs):
    """What BY_LENGTH with every repeat leaves; docs: id to text."""
    first = {}
    for i in sorted(docs):
        for p, x in enumerate((docs[i] or "").split("\n")):
            first.setdefault(x, (i, p))
    long = [x for x in first if len(x) >= 20]
    gone = {x for x in long for y in long if first[y] < first[x] and abs(len(x) - len(y)) <= 4 and edits(x, y) <= steps_of(min(len(x), len(y)))}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not x or x not in gone and first[x] == (i, p)) for i, t in docs.items()}


def changed(rng, base, most, letters="abcé "):
    b = list(base)
    for _ in range(rng.randint(0, most)):
        b[(k := rng.randint(0, len(b))) : k + rng.randint(0, 1)] = rng.choice(["", *letters])
    return "".join(b)


@pytest.mark.parametrize("sizes", [(20, 27, 28, 63, 64), (253, 256, 320), (511, 514)])
def test_by_length(spark, sizes):
    rng = random.Random(sum(sizes))
    bases = ["".join(rng.choice("abcdeé ") for _ in range(n)) for n in sizes]
    docs = ["\n".join(changed(rng, b, 5) for b in bases) for _ in range(12)] + [None, "", "short", "short\n\nx"]
    assert texts_of(lines.deduplicated(frame(spark, docs), lines.BY_LENGTH, every_repeat=True)) == brute_by_length(dict(enumerate(docs)))


@pytest.mark.parametrize("crowd", [0, 3])
def test_crowded_keys_lose_nothing(spark, crowd):
    rng = random.Random(crowd)
    head = "".join(rng.choice("abcde ") for _ in range(150))
    docs = ["\n".join(head + changed(rng, "eeabc tail of the line " * 6, 4) for _ in range(4)) for _ in range(12)]
    df = frame(spark, docs).select("doc_id", "text")
    found = lines.dropped_lines(df, lines.BY_LENGTH, every_repeat=True, crowd=crowd).select("doc_id", "pos").collect()
    kept = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in {tuple(r) for r in found}) for i, t in enumerate(docs)}
    assert kept == brute_by_length(dict(enumerate(docs))) and kept != dict(enumerate(docs))


def test_rows_that_share_an_id(spark):
    one, two = "A line that both of them have\nsecond line of document one", "unrelated beginnings of a text\nA line that both of them have"
    got = sorted(r.text for r in lines.deduplicated(spark.createDataFrame([(1, one), (1, two), (2, one), (2, one)], "doc_id long, text string")).collect())
    kept = "\n".join(got)
    assert kept.count("A line that both") == 1 and kept.count("second line of document one") == 1 and kept.count("unrelated beginnings") == 1
    same = lines.deduplicated(spark.createDataFrame([(1, one), (1, one)], "doc_id long, text string")).collect()
    assert [r.text for r in same] == [one, one]


def test_names_that_clash(spark):
    names = ("dropped_at", "dropped_id", "lines_near", "LINES_REPEATED", "th", "at", "near", "k", "pos")
    df = spark.createDataFrame([(i, "the same line in both of them", *range(len(names))) for i in range(2)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = lines.deduplicated(df).orderBy("doc_id").collect()
    assert [tuple(r[n] for n in names) for r in got] == [tuple(range(len(names)))] * 2 and [r.text for r in got] == ["the same line in both of them", ""]
    assert [(r.lines_near_, r.lines_repeated_) for r in got] == [(0, 0), (0, 1)]


def test_a_very_long_line(spark):
    rng = random.Random(4)
    x = "".join(rng.choice("abcdefg hij") for _ in range(100_000))
    docs = [x, x[:70_000] + "ZZ" + x[70_001:], "a" + x[2:-1], x[::-1]]
    got = texts_of(lines.deduplicated(frame(spark, docs), lines.BY_LENGTH, every_repeat=True))
    assert got == {0: x, 1: "", 2: "", 3: x[::-1]}
