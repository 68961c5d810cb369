"""What the operators left undone, each against brute force."""

import random

import pytest

from skein.llm import lines, winnow

from .test_llm import edits, frame, texts_of


def scaled_edits(x, y):
    return min(20, min(len(x), len(y)) // 10)


def near(x, y):
    """By the plain table of distances, of which only the cells within the edits allowed of the diagonal matter."""
    most, far = scaled_edits(x, y), 99
    row = {j: j for j in range(min(len(y), most) + 1)}
    for i, a in enumerate(x, 1):
        new = {i - 1 - most: far}
        for j in range(max(0, i - most), min(len(y), i + most) + 1):
            new[j] = i if j == 0 else min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (a != y[j - 1]))
        row = new
    return row.get(len(y), far) <= most


def test_table_of_distances():
    rng = random.Random(1)
    for _ in range(300):
        x, y = ("".join(rng.choice("ab") for _ in range(rng.randint(20, 32))) for _ in range(2))
        assert near(x, y) == (edits(x, y) <= scaled_edits(x, y))


def brute_scaled(docs, every_length=False):
    first = {}
    for i in sorted(docs):
        for p, x in enumerate((docs[i] or "").split("\n")):
            first.setdefault(x, (i, p))
    long = [x for x in first if len(x) >= 20]
    gone = {x for x in long for y in long if first[y] < first[x] and abs(len(x) - len(y)) <= scaled_edits(x, y) and near(x, y)}
    least = 1 if every_length else 20
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if len(x) < least or not x or x not in gone and first[x] == (i, p)) for i, t in docs.items()}


def edited_lines(seed, sizes, letters):
    rng, docs = random.Random(seed), []
    bases = ["".join(rng.choice(letters) for _ in range(n)) for n in sizes]
    for _ in range(16):
        own = []
        for b in rng.sample(bases, 3):
            b = list(b)
            for _ in range(rng.randint(0, min(24, len(b) // 8))):
                b[(k := rng.randint(0, len(b))) : k + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
            own.append("".join(b))
        docs.append("\n".join(own))
    return docs


@pytest.mark.parametrize("sizes", [(20, 24, 31, 39, 40, 42), (60, 99, 105, 150), (200, 205, 330, 340), (560, 675, 1340)])
def test_edits_follow_the_length(spark, sizes):
    docs = edited_lines(sum(sizes), sizes, "abcdeé😀 ") + [None, "", "short"]
    got = texts_of(lines.deduplicated(frame(spark, docs), None))
    assert got == brute_scaled(dict(enumerate(docs)))
    assert got != texts_of(lines.deduplicated(frame(spark, docs)))


def test_short_repeats_go(spark):
    docs = dict(enumerate(["Les.\n\nquite a long line stays here\n今日は。", "Les.\n\n今日は。\nLet.", None, "", "a\na"]))
    got = texts_of(lines.deduplicated(frame(spark, docs.values()), every_repeat=True))
    assert got == {0: docs[0], 1: "\nLet.", 2: None, 3: "", 4: "a"}
    docs = edited_lines(5, (5, 12, 21, 30), "abcd ") * 2
    assert texts_of(lines.deduplicated(frame(spark, docs), None, every_repeat=True)) == brute_scaled(dict(enumerate(docs)), True)


def test_half_of_a_short_text_is_found():
    rng = random.Random(3)
    for n in [*range(16, 130), 500, 767, 768, 3000]:
        text, following = ("".join(rng.choice("abcdefgh 日é") for _ in range(n)) for _ in range(2))
        new = winnow.edited(text, following)
        assert len(new) == n and set(winnow.winnow(text)[:, 0]) & set(winnow.winnow(new)[:, 0])
        assert set(winnow.winnow(text)[:, 0]) & set(winnow.winnow(winnow.edited(text, ""))[:, 0])
