"""Masks, stops, BLEU, byte pairs, repair, alias tables, tars and the staged stream against brute force and edge cases."""

import collections
import io
import math
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import byte_bpe, clean
from skein.operators import bleu, conversation, decoding, manifold, masks, questions, rows, sequences
from skein.sources import tars
from skein.streaming import staged


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(values, kind="array<int>"):
    return F.array(*[F.lit(v) for v in values]).cast(kind)


# Q13, Q14


def brute_marker(ids, marker, end):
    out, i = [-100] * len(ids), 0
    while i < len(ids) - len(marker):
        if ids[i : i + len(marker)] == marker:
            i += len(marker)
            while i < len(ids):
                out[i] = ids[i]
                i += 1
                if ids[i - 1] == end:
                    break
        else:
            i += 1
    return out


@pytest.mark.parametrize("marker", [[1, 2], [1], [1, 1], [2, 3]])
def test_marker_labels(spark, marker):
    rng = random.Random(5)
    cases = [[], [1], [1, 2], [1, 2, 9], [1, 2, 1, 2, 3, 1, 2, 7], [1, 1, 1, 1], [2, 3, 2, 3, 5]] + [[rng.randint(1, 4) for _ in range(rng.randint(0, 14))] for _ in range(60)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, ids array<int>")
    got = {r.k: r.y for r in df.select("k", sequences.assistant_labels(F.col("ids"), marker, 3).alias("y")).collect()}
    for k, c in enumerate(cases):
        assert got[k] == brute_marker(c, marker, 3)


def brute_turns(prompt, style, t, tokens, begin, most, after_first):
    length = lambda x: len(tokens(x)) + begin
    ids = (["<s>"] * begin + tokens(prompt))[:most]
    keep = [True] * len(ids)
    if style == "two":
        rounds, sep, back, at = prompt.split(t.sep2), t.sep + t.assistant + ": ", 2, 1
    else:
        p = prompt.split(t.sep)
        rounds, sep, back, at = [t.sep.join(p[:3])] + [t.sep.join(p[i : i + 2]) for i in range(3, len(p), 2)], t.sep + t.assistant, 1, 0
    for i in range(min(at, len(ids))):
        keep[i] = False
    for i, r in enumerate(rounds):
        parts = r.split(sep)
        if r == "" or len(parts) != 2:
            break
        n, own = length(r), length(parts[0] + sep) - back
        if i:
            n, own = n + after_first, own + after_first
        for k in range(at, min(at + max(own, 0), len(ids))):
            keep[k] = False
        at += n
    for k in range(at, len(ids)):
        keep[k] = False
    if at < most and at != len(ids):
        keep = [False] * len(ids)
    return keep


@pytest.mark.parametrize("style,after", [("two", 0), ("two", -1), ("mpt", 0), ("mpt", 1)])
def test_turn_labels(spark, style, after):
    import re

    t = conversation.TEMPLATES["vicuna_v1" if style == "two" else "mpt"]
    pattern = r"</s>|[^ \n<]+|<"
    tok = masks.PatternTokenizer(pattern, begin=1 if style == "two" else None, dropped=None if style == "two" else "<|im_end|>")
    tokens = lambda x: re.findall(pattern, x if style == "two" else x.replace("<|im_end|>", " "))
    if style == "two":
        prompts = ["S USER: a b ASSISTANT: c d</s>USER: e ASSISTANT: f</s>", "S USER: a ASSISTANT: b", "S USER: a b", "", "S</s></s>USER: x ASSISTANT: y</s>", "S USER: a ASSISTANT: b ASSISTANT: c</s>", "S USER: a ASSISTANT: " + "w " * 40 + "</s>", "S USER:  ASSISTANT: q</s>"]
    else:
        u, g, e = t.user, t.assistant, t.sep
        prompts = [f"S{e}{u}a b{e}{g}c d{e}{u}e{e}{g}f{e}", f"S{e}{u}a{e}", "", f"S{e}{u}a{e}{g}b{e}{u}c{e}", f"S{e}{u}a{e}{g}{'w ' * 40}{e}"]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(prompts)], "k int, p string")
    for most in (16, 64):
        got = {r.k: r.y for r in df.select("k", masks.turn_labels(F.col("p"), t, tok, most, after).alias("y")).collect()}
        for k, p in enumerate(prompts):
            assert [y != -100 for y in got[k]] == brute_turns(p, style, t, tokens, int(style == "two"), most, after), (p, most)


def test_turn_labels_need_a_known_template(spark):
    with pytest.raises(ValueError):
        masks.rounds_of(F.lit("x"), conversation.TEMPLATES["gemma"])
    got = one(spark, masks.signal_labels(array(range(12)), F.lit(2), array([4, 1, 3]), array(["human", "human", "gpt"], "array<string>")))
    assert got == [-100, -100, 2, 3, -100, -100, 6, 7, 8, 9, 10, 11]


# A14


def brute_bleu(cases, most=4):
    hit, every, p_len, r_len = [0] * most, [0] * most, 0, 0
    for hyp, refs in cases:
        words = lambda x: "".join(" " if c in ".,?!:;'`-" else c for c in (x or "").lower()).split()
        h, rs = words(hyp), [words(r) for r in refs or [] if r is not None]
        p_len += len(h)
        r_len += min(((abs(len(r) - len(h)), len(r)) for r in rs), default=(0, 0))[1]
        for n in range(1, most + 1):
            c = collections.Counter(tuple(h[i : i + n]) for i in range(len(h) - n + 1))
            best = collections.Counter()
            for r in rs:
                best |= collections.Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
            hit[n - 1] += sum((c & best).values())
            every[n - 1] += sum(c.values())
    out, prod = [], 1.0
    ratio = (p_len + 1e-15) / (r_len + 1e-9)
    for n in range(most):
        prod *= (hit[n] + 1e-15) / (every[n] + 1e-9)
        out.append(prod ** (1 / (n + 1)) * (math.exp(1 - 1 / ratio) if ratio < 1 else 1))
    return out


def test_corpus_bleu(spark):
    cases = {
        "a": [("the cat sat on the mat", ["The cat is on the mat.", "there is a cat on the mat"]), ("the the the the", ["the cat", None]), ("", ["x"]), (None, ["y z"])],
        "b": [("a b c d e f", ["a b c d e f"]), ("g", [])],
        "c": [("nothing", None)],
    }
    df = spark.createDataFrame([(g, k, h, r) for g, rows_ in cases.items() for k, (h, r) in enumerate(rows_)], "g string, k int, h string, r array<string>")
    got = {r.g: [r.bleu1, r.bleu2, r.bleu3, r.bleu4] for r in bleu.corpus_bleu(df, "g", "k", "h", "r").collect()}
    for g, rows_ in cases.items():
        assert got[g] == pytest.approx(brute_bleu(rows_), rel=1e-9, abs=1e-12)
    assert bleu.corpus_bleu(df.limit(0), "g", "k", "h", "r").count() == 0


# A35


def test_realism_over_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(37, 4)), rng.normal(size=(41, 4))
    y[7], r = x[3], rng.random(41)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    balls = spark.createDataFrame([(k, v.tolist(), float(a)) for k, (v, a) in enumerate(zip(y, r, strict=True))], "id long, v array<double>, radius double")
    whole = manifold.paired_blocks
    monkeypatch.setattr(manifold, "paired_blocks", lambda *a: whole(*a, block_rows=10))
    d = ((x[:, None] - y[None]) ** 2).sum(-1)
    for prune in (False, True):
        got = {g.id: (g.realism, g.nearest) for g in manifold.realism(points, balls, prune=prune).collect()}
        used = np.where(r <= np.median(r), r, -1) if prune else r
        for k in range(37):
            assert got[k][0] == pytest.approx((used / (d[k] + 1e-5)).max(), rel=1e-6) and got[k][1] == d[k].argmin()


# A24, A25


def test_question_runs(spark):
    lines = [("a", 1, "skipped"), ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("a", 3, "later"), ("a", 3, "last"), (None, 1, "n"), ("b", 1, "zz")]
    df = spark.createDataFrame([(k, i, q, f"{v} - w (k)", "0, 2" if q == 3 else "1", v, "clash") for k, (i, q, v) in enumerate(lines)], "o long, item_id string, proposition_id int, tuple string, dependency string, question string, line string")
    got = {(r.item, r.qid): (r.place, r.question, r.parents) for r in questions.question_table(df, "o").collect()}
    assert got == {("a", 3): (4, "last", [0, 2]), ("b", 1): (7, "zz", [1]), (None, 1): (6, "n", [1])}
    answers = spark.createDataFrame([("a", 0, 3, "yes"), ("a", 1, 3, "no"), ("b", 0, 1, "yes")], "item string, crop int, qid int, answer string")
    means = {(r.level, r.category): (r["mean"], r.n) for r in questions.category_means(questions.question_table(df, "o"), answers).collect()}
    assert means == {(1, "last"): (0.0, 1), (1, "zz"): (1.0, 1), (2, "last - w"): (0.0, 1), (2, "zz - w"): (1.0, 1)}


# M4, Q24


def test_after_trigger(spark):
    rng = random.Random(8)
    seqs = {k: [rng.choice("abcT") for _ in range(n)] for k, n in enumerate([0, 1, 7, 40, 200])}
    df = spark.createDataFrame([(k, p, x) for k, s in seqs.items() for p, x in enumerate(s)], "k int, p int, x string")
    for width, offset in ((1, 1), (3, 2), (16, 5)):
        got = {(r.k, r.p): (r.in_window, r.at_offset) for r in decoding.after_trigger(df, "k", "p", "x", "T", width, offset).collect()}
        assert len(got) == 248
        for (k, p), g in got.items():
            s = seqs[k]
            assert g == ("T" in s[max(0, p - width) : p], p >= offset and s[p - offset] == "T")


def test_step_masks(spark):
    x, no = array([0.0, 1.0, 2.0], "array<double>"), float("-inf")
    ids = array([5, 7, 9])
    assert one(spark, decoding.disallow_in_range(ids, x, [0], 3)) == [no, 1, 2] and one(spark, decoding.disallow_in_range(ids, x, [0], 0, 3)) == [0, 1, 2]
    assert one(spark, decoding.allow_in_range(ids, x, [2], F.lit(1), F.lit(4))) == [no, no, 2] and one(spark, decoding.allow_in_range(ids, x, [2], 4)) == [0, 1, 2]
    assert one(spark, decoding.allow_at_offset(ids, x, 7, [1], 2)) == [no, 1, no] and one(spark, decoding.allow_at_offset(ids, x, 7, [1], 9)) == [0, 1, 2]
    assert one(spark, decoding.allow_in_window(ids, x, 5, [1], 3)) == [no, 1, no] and one(spark, decoding.allow_in_window(ids, x, 5, [1], 2)) == [0, 1, 2]
    assert one(spark, decoding.allow_in_window(array([]), x, 5, [1], 2)) == [0, 1, 2]


def test_stops(spark):
    s = one(spark, decoding.stops(array([4, 1, 2, 9, 1, 2, 3]), 5, 9, 4, [[1, 2], [2, 3]], begin=3))
    assert (s.max_length, s.end, s.end_after, s.keyword, s.first) == (5, 4, None, 6, 4)
    s = one(spark, decoding.stops(array([]), 5, 9, 0, []))
    assert set(s.asDict().values()) == {None}


# F13, F14


def test_repair():
    for text in ("déjà vu — “quotes” 日本語 😀", "naïve", "ASCII only", "", "Ã", "Â", "â€", "ÿþ"):
        wrong = text.encode().decode("latin-1")
        assert clean.repaired(wrong) == clean.repaired(text)
    assert clean.repaired("cafÃ© au lait, â€œqâ€\x9d") == "café au lait, “q”" and clean.repaired("Ã is a letter") == "Ã is a letter"
    assert clean.cleaned(" A&amp;amp;B &eacute;&#233;&#xe9;\n\t Ｃ &zzz; ") == "a&b ééé ｃ &zzz;"


def test_clean_in_batches(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "X&lt;Y" * 10_000), (3, "x\x1cy")], "k int, t string")
    got = {r.k: r.y for r in df.select("k", clean.clean_text(F.col("t")).alias("y")).collect()}
    assert got == {0: None, 1: "", 2: "x<y" * 10_000, 3: "x y"}
    assert df.limit(0).select(clean.repair_encoding(F.col("t"))).count() == 0


def test_byte_pairs_equal_the_library(spark):
    from tokenizers import Tokenizer

    from skein.plans.tokens import merges_file

    t, bpe = Tokenizer.from_file(merges_file()), byte_bpe.ByteBpe(byte_bpe.merges_of(merges_file()))
    rng = random.Random(2)
    texts = ["", "hello world", "Don't WE'LL", "日本 ½ 12345 😀", "x" * 5000, "naïve café"] + ["".join(rng.choice("aeionrst '.,19é😀") for _ in range(rng.randint(0, 50))) for _ in range(300)]
    for x in texts:
        ids = bpe.encode(x)
        assert ids == t.encode(clean.cleaned(x), add_special_tokens=False).ids
        words = bpe.pattern.findall(clean.cleaned(x))
        assert bpe.decode(ids) == "".join(w + " " for w in words)
    assert bpe.encode("a <start_of_text> b") == [*bpe.encode("a"), 49406, *bpe.encode("b")]
    rows_ = byte_bpe.encoded(spark.createDataFrame([(1, None), (2, "w " * 100), (3, "a b")], "k long, t string"), "k", "t", merges_file(), length=8).collect()
    got = {r.k: (r.n, r.ids) for r in rows_}
    assert got[1] == (0, [49406, 49407, 0, 0, 0, 0, 0, 0]) and got[2][0] == 100 and got[2][1][0] == 49406 and got[2][1][-1] == 49407 and 49407 not in got[2][1][:-1]
    assert got[3][1] == [49406, *bpe.encode("a b"), 49407, 0, 0, 0, 0]


# L8


def test_alias_tables(spark, monkeypatch):
    for w in ([1.0], [1, 1, 1], [5, 1, 0.5, 100], np.random.default_rng(3).random(500) ** 4 + 1e-6):
        share, other = rows.alias_cells(w)
        mass = np.zeros(len(w))
        np.add.at(mass, np.arange(len(w)), share)
        np.add.at(mass, other, 1 - share)
        assert mass / len(w) == pytest.approx(np.asarray(w) / np.sum(w), abs=1e-12) and (share >= -1e-12).all() and (share <= 1 + 1e-12).all()
    monkeypatch.setattr(rows, "CELLS", 8)  # three levels of tables
    items = spark.createDataFrame([(10 * k, float(k % 7 + 1) if k else 400.0, "clash") for k in range(100)], "id long, w double, cell string")
    n = 20_000
    drawn = rows.weighted_with_replacement(items, "w", n, 4, "id")
    assert drawn.columns == ["draw", "id", "w", "cell"]
    got = {r.id: r["count"] for r in drawn.groupBy("id").count().collect()}
    assert sum(got.values()) == n
    total = sum(r.w for r in items.collect())
    chi = sum((got.get(r.id, 0) - n * r.w / total) ** 2 / (n * r.w / total) for r in items.collect())
    assert chi < 170  # 99 degrees of freedom
    with pytest.raises(Exception, match="positive"):
        rows.weighted_with_replacement(items.withColumn("w", F.lit(0.0)), "w", 5, 1, "id").count()
    with pytest.raises(ValueError):
        rows.weighted_with_replacement(items.limit(0), "w", 5, 1, "id")


# X8, S7


def tar_of(path, members, cut=None):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    path.write_bytes(out.getvalue()[:cut])


def test_tars_as_streams(spark, tmp_path):
    big = bytes(range(256)) * 40
    tar_of(tmp_path / "a.tar", [("x/1.TXT", b"one"), ("x/1.json", b"{}"), ("x/2.txt", big), ("noext", b"-"), ("x/2.txt", b"again"), ("x/3.tar.gz", b"")])
    tar_of(tmp_path / "b.tar", [("k.txt", b"fine"), ("l.txt", big)], cut=512 * 5)  # ends within the second member
    (tmp_path / "c.tar").write_bytes(b"no tar at all" * 100)
    (tmp_path / "d.tar").write_bytes(b"")
    parts = tars.members(spark, str(tmp_path), part_bytes=1000)
    whole = {(r.url[-5:], r.pos): (r.key, r.suffix, bytes(r.data)) for r in tars.whole(parts).collect()}
    assert whole[("a.tar", 0)] == ("x/1", "txt", b"one") and whole[("a.tar", 2)] == ("x/2", "txt", big) and whole[("a.tar", 4)] == ("x/2", "txt", b"again") and whole[("a.tar", 5)] == ("x/3", "tar.gz", b"")
    assert ("a.tar", 3) not in whole and whole[("b.tar", 0)] == ("k", "txt", b"fine")
    bad = {r.url[-5:]: r.pos for r in tars.damaged(parts).collect()}
    assert bad == {"b.tar": 1, "c.tar": 0}
    found = tars.samples(tars.whole(parts).where("url like '%a.tar'"), ["txt", "json"])
    assert sorted((r.key, sorted(r.members)) for r in found.collect()) == [("x/1", ["json", "txt"]), ("x/2", ["txt"]), ("x/2", ["txt"])]


# ST2


def test_shuffle_survives_a_restart(spark, tmp_path):
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    schema = "k long, w double, slot int"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
        made = staged.staged(stream, staged.shuffled("k", slots=3, size=10, seed=1, batch=4))
        made.writeStream.outputMode("append").option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("append").parquet(out)).start().awaitTermination()

    def feed(low, high):
        spark.range(low, high).select(F.col("id").alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") / 2).alias("w"), F.lit(None).cast("int").alias("slot")).repartition(3).write.mode("append").parquet(source)

    feed(0, 100)
    run()
    first = spark.read.parquet(out).count()
    assert first == 100 - 3 * 10  # the buffers hold the rest
    feed(100, 150)
    run()  # goes on from the checkpoint
    assert spark.read.parquet(out).count() == 120
    staged.closing(spark.createDataFrame([], schema), "k", 3).coalesce(1).write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(out).collect()
    assert sorted(r.k for r in got) == list(range(150)) and all(r.w == (r.k / 2 if r.k % 5 else None) for r in got)
    by_batch = collections.Counter((r.slot, r.batch) for r in got)
    assert len({(r.slot, r.batch, r.place) for r in got}) == 150 and all(by_batch[s, b] == 4 for s, b in by_batch if (s, b + 1) in by_batch)
    order = [r.k for r in sorted(got, key=lambda r: (r.slot, r.batch, r.place))]
    assert any(a > b for a, b in zip(order, order[1:], strict=False))
