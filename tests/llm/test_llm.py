"""The training-data operators against brute force, the tokenizers library and edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skein.llm import ann, bpe, jaccard, langid, lines, packing, pii, token_counts, toxicity, winnow
from skein.llm.common import vocabulary
from skein.llm.tokens import byte_tokenizer

D = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "a", "ΑΣ ΑΣΑ İ ﬁ", "don't we'LL <|endoftext|> x<|startoftext|>", "a\x1cb\x85c  d", "日本語 ½ 12345", "😀👨‍👩‍👧 é é", "</w> a</w>b", "word " * 20000, "x" * 30000, "same text", "same text"]


def frame(spark, texts, extra=True):
    rows = [(i, t, "en", "s", -1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("score", F.lit("clash")).withColumn("h", F.lit(0)) if extra else df


def documents(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# 1


def test_bpe_equals_the_library(spark):
    t, e = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), bpe.PrefixEncoder(vocabulary("word_bpe_49k.json"))
    rng = random.Random(4)
    letters = "aaeiounrstl'’.,!?-_ 0129ßéñΣσ\t\n<>w/|日😀"
    texts = [x or "" for x in ODD] + list(texts_of(documents(spark)).values()) + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for x in texts:
        want = t.encode(x or "", add_special_tokens=False).ids
        assert e.encode(x) == want
        assert e.decode(want) == t.decode(want, skip_special_tokens=False)


def test_bpe_pair_test_is_the_definition():
    e = bpe.PrefixEncoder(vocabulary("word_bpe_49k.json"))

    def letters(i):
        return [i] if i not in e.parts else letters(e.parts[i][0]) + letters(e.parts[i][1])

    into = {x << 16 | y: z for z, (x, y, _) in e.parts.items()}

    def merge(ids):
        while True:
            found = [(e.rank[p], k) for k in range(len(ids) - 1) if (p := ids[k] << 16 | ids[k + 1]) in e.rank]
            if not found:
                return ids
            k = min(found)[1]
            ids = [*ids[:k], into[ids[k] << 16 | ids[k + 1]], *ids[k + 2 :]]

    rng = random.Random(1)
    inner = [i for t, i in e.ids.items() if not t.endswith(bpe.END) and merge(letters(i)) == [i]]
    for _ in range(4000):
        a, b = rng.choice(inner), rng.choice(inner)
        assert (e._crossing(a << 16 | b) is None) == (merge(letters(a) + letters(b)) == [a, b])


def test_bpe_rows(spark, empty):
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = {r.doc_id: r for r in bpe.digest_documents(frame(spark, ODD)).collect()}
    full = {r.doc_id: r for r in bpe.encode_documents(frame(spark, ODD)).collect()}
    for i, x in enumerate(ODD):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and full[i].ids == ids and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.digest_documents(empty).count() == 0


# 2, 6


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.score_documents(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    hit = sum(r.predicted for r in got if r.toxic)
    assert hit >= 0.6 * sum(r.toxic for r in got) and sum(r.predicted for r in got if not r.toxic) <= 0.05 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_toxicity_edges(spark, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = frame(spark, ODD)
    got = toxicity.score_documents(odd, toxicity.fit(odd, none)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score < 0.7 for r in got)
    some = spark.createDataFrame([(i, i % 2) for i in range(len(ODD))] + [(1, None)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score_documents(odd, toxicity.fit(odd, some)).collect())
    assert toxicity.score_documents(empty, toxicity.fit(empty, none)).count() == 0


def test_negative_risk_is_turned_round():
    rng = np.random.default_rng(0)
    pos, unl = [rng.integers(0, 50, 5) for _ in range(40)], [rng.integers(0, 400, 5) for _ in range(200)]
    weights, bias = toxicity.learn(pos, unl, 0.3)
    assert np.isfinite(weights).all() and np.mean([weights[p].sum() for p in pos]) > np.mean([weights[u].sum() for u in unl])


def test_language_on_held_out_rows(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    got = langid.predict_documents(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    odd = {r.doc_id: r for r in langid.predict_documents(frame(spark, [None, "", "12 !", "le monde", "日本"]), model).collect()}
    assert [odd[i].lang_pred == "und" for i in range(5)] == [True, True, True, False, False]
    assert {r.lang_pred for r in langid.predict_documents(frame(spark, ODD), langid.fit(empty)).collect()} == {"und"}


# 3, 7


@pytest.mark.parametrize("size", [16, 2048])
def test_packing_keeps_every_id_once(spark, size):
    docs = frame(spark, ODD).unionByName(frame(spark, ["t " * k for k in range(40)]).withColumn("doc_id", F.col("doc_id") + 100))
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = packing.pack(docs, size, pool=4).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, text in texts_of(docs).items():
        ids, at = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or at & (at - 1) == 0


def test_risk_gradients_against_differences():
    rng = np.random.default_rng(11)
    plus, minus = (lambda z: np.logaddexp(0, -z)), (lambda z: np.logaddexp(0, z))  # losses of calling a score positive, negative
    branches = set()
    for shift, prior in ((-3.0, 0.1), (0.0, 0.3), (4.0, 0.5), (-6.0, 0.5)):
        z_pos, z_unl = rng.normal(size=6) + abs(shift), rng.normal(size=9) + shift
        rest = lambda a, b, prior=prior: minus(b).mean() - prior * minus(a).mean()
        below = rest(z_pos, z_unl) < 0
        branches.add(bool(below))
        # the whole risk where its second part is positive, else that part alone, turned round
        risk = (lambda a, b: -rest(a, b)) if below else (lambda a, b, prior=prior: prior * plus(a).mean() + rest(a, b))
        got = toxicity.gradients(z_pos, z_unl, prior)
        for k, z in enumerate((z_pos, z_unl)):
            for i in range(len(z)):
                up, down = [z_pos.copy(), z_unl.copy()], [z_pos.copy(), z_unl.copy()]
                up[k][i] += 1e-5
                down[k][i] -= 1e-5
                assert abs((risk(*up) - risk(*down)) / 2e-5 - got[k][i]) < 1e-6
    assert branches == {True, False}


def test_thinned_features_learn_the_same():
    rng = np.random.default_rng(12)
    docs = [np.unique(rng.integers(0, 400, 40)).astype("<u4") for _ in range(120)]
    pos = [np.unique(np.append(d, [500, 501])).astype("<u4") for d in docs[:40]]
    unl = docs[40:] + pos[:10]
    size = 1 << toxicity.BITS
    scale = toxicity.scales(*(np.bincount(np.concatenate(d), minlength=size).astype(float) for d in (pos, unl)), len(pos), len(unl))
    thin = [[d[scale[d] != 0] for d in side] for side in (pos, unl)]
    a, b = toxicity.learn(pos, unl, 0.2), toxicity.learn(*thin, 0.2, scale=scale)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_packing_hardly_depends_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    figures = []
    for n in (1, 200):
        got = packing.pack(docs.repartition(n)).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces")).collect()
        figures.append((sum(r.n < 2048 for r in got), sum(r.pieces for r in got), sum(r.n for r in got)))
        assert all(r.n == 2048 or r.n & (r.n - 1) == 0 for r in got)
    (short_1, pieces_1, tokens_1), (short_200, pieces_200, tokens_200) = figures
    assert tokens_1 == tokens_200 and max(short_1, short_200) <= 11 and abs(pieces_200 - pieces_1) <= 0.1 * pieces_1


def test_the_lowest_cost_with_room_is_chosen():
    rng = np.random.default_rng(7)
    lengths = rng.integers(1, 2048, 300)
    seqs, caps = packing.deal(lengths, 2048, 1.0, 1 / 1024)
    room, cost, placed = list(caps), [0.0] * len(caps), [[] for _ in caps]
    for item in sorted(range(300), key=lambda i: (-lengths[i], i)):
        n = int(lengths[item])
        fits = [k for k in range(len(caps)) if room[k] >= n]
        if fits:
            k = min(fits, key=lambda k: (cost[k], k))
            placed[k].append((item, 0, n))
            room[k] -= n
            cost[k] += n + n * n / 1024
    assert all(s[: len(p)] == p for s, p in zip(seqs, placed, strict=True))


def test_deal_is_balanced():
    lengths = np.random.default_rng(2).integers(1, 2048, 300)
    seqs, caps = packing.deal(lengths, 2048, 1.0, 1 / 1024)
    assert [sum(n for _, _, n in s) for s in seqs] == caps and sum(caps) == lengths.sum()


def test_byte_ids_equal_the_library(spark):
    t, own = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), byte_tokenizer(vocabulary("byte_bpe_50k.json"))
    for x in [x or "" for x in ODD] + list(texts_of(documents(spark)).values()) + ["a  b\n\n c \t", " <|endoftext|>  x", "  \n"]:
        assert own.ids(x).tolist() == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_token_counts_across_blocks(spark, tmp_path, block):
    rng, want, files = np.random.default_rng(0), {}, []
    for i, n in enumerate((0, 1, 5, 1000, 777)):
        ids = rng.integers(1, 9, n).astype("<u2")
        ids[rng.random(n) < (0.2, 1, 0.3, 0.01, 0)[i]] = 50256
        name = f"{tmp_path}/f{i}.bin"
        ids.tofile(name)
        files.append((f"file://{name}", ids.nbytes))
        ends = [-1, *np.flatnonzero(ids == 50256)]
        want[f"file://{name}"] = [int(b - a - 1) for a, b in zip(ends, ends[1:])] + ([n - 1 - int(ends[-1])] if n - 1 > ends[-1] else [])
    got = {f: [] for f, _ in files}
    for r in sorted(token_counts.count_tokens(spark.createDataFrame(files, "file string, bytes long"), block_bytes=block).collect(), key=lambda r: (r.file, r.ordinal)):
        got[r.file].append(r.n_tokens)
    assert got == want


def test_document_token_counts(spark, empty):
    own = byte_tokenizer(vocabulary("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_document_tokens(spark, frame(spark, ODD)).collect()}
    assert got == {i: len(own.ids(x, special=False)) for i, x in enumerate(ODD)}
    assert token_counts.count_document_tokens(spark, empty).count() == 0


# 4


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_bit_parallel_distance(spark, most):
    rng, pairs = random.Random(2), []
    for _ in range(800):
        a = [rng.choice("abé😀") for _ in range(rng.randint(0, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b[(k := rng.randint(0, len(b))) : k + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
        pairs.append(("".join(a), "".join(b)))
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", lines.within_edits(F.col("x"), F.col("y"), most).alias("near")).collect()
    assert [r.near for r in got] == [edits(r.x, r.y) <= most for r in got]


def brute_lines(docs, most, least):
    first, seen = {}, []
    for i in sorted(docs):
        for p, x in enumerate((docs[i] or "").split("\n")):
            if docs[i] is not None and len(x) >= least:
                seen.append((i, p, x))
                first.setdefault(x, (i, p))
    near = {x for x in first for y in first if first[y] < first[x] and abs(len(x) - len(y)) <= most and edits(x, y) <= most}
    gone = {(i, p) for i, p, x in seen if x in near or first[x] != (i, p)}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs.items()}


@pytest.mark.parametrize("most", [1, 2])
def test_lines_against_brute_force(spark, most):
    rng = random.Random(most)
    bases = ["".join(rng.choice("abcd ") for _ in range(rng.randint(8, 14))) for _ in range(12)]
    docs = []
    for _ in range(25):
        own = []
        for _ in range(rng.randint(0, 6)):
            b = list(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                b[(k := rng.randint(0, len(b))) : k + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
            own.append("".join(b))
        docs.append("\n".join(own))
    docs += [None, "", "\n", "short"]
    got = lines.deduplicated(frame(spark, docs), most, 6).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(dict(enumerate(docs)), most, 6)
    assert got[0].score == "clash"


def test_lines_edges(spark, empty):
    assert lines.deduplicated(empty).count() == 0
    got = {r.doc_id: r.text for r in lines.deduplicated(frame(spark, ODD)).collect()}
    assert got == brute_lines({i: x if x is None or len(x) < 1000 else x for i, x in enumerate(ODD)}, 0, 20)


# 5


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(300, 16)), np.repeat(rng.normal(size=(1, 16)), 120, 0)]).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(1000, None, "x"), (1001, [0.0] * 16, "x"), (1002, [float("nan")] * 16, "x"), (1003, [None] * 16, "x"), (1004, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = ann.search(df, block_rows=100, block_queries=3).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = []
    for query in range(0, 420, 50):
        s = (u * u[query]).sum(1)
        s[query] = -9
        want = sorted(range(420), key=lambda i: (-round(s[i], 12), i))[:5]
        mine = sorted((r for r in got if r.query_id == query), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and all(abs(r.score - u[r.vec_id] @ u[query]) < 1e-9 for r in mine)
        hits.append(len({r.vec_id for r in mine} & set(want)) / 5)
    assert np.mean(hits) >= 0.9 and {r.query_id for r in got} == set(range(0, 420, 50))
    few = spark.createDataFrame([(0, [1.0, 2.0], ""), (7, [2.0, 4.0], ""), (3, [1.0, 2.0], "")], "vec_id long, embedding array<float>, s string")
    assert [(r.rank, r.vec_id) for r in ann.search(few).orderBy("rank").collect()] == [(1, 3), (2, 7)]
    assert ann.search(few.where("false")).count() == 0


# 8

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(digits[::-1]))
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and odd % 10 == 0) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data_equals_the_patterns(spark, empty):
    rng = random.Random(7)
    texts = [x or "" for x in ODD] + ["".join(rng.choice("012345 9.-+@a.b()%é") for _ in range(rng.randint(0, 40))) for _ in range(20000)] + list(texts_of(documents(spark)).values())
    for x in texts:
        assert pii.joined(pii.find(x), pii.BASE) == base_spans(x)
    found = pii.find("see https://a.example/b?c=1. IBAN: DE89 3704 0044 0532 0130 00, account no")
    assert found["url"] == [(4, 27)] and len(found["account"]) == 1
    assert pii.masked("mail a.b@c.org now", pii.find("mail a.b@c.org now")) == "mail <email> now"
    got = {r.doc_id: r for r in pii.find_documents(frame(spark, ODD)).collect()}
    assert all(got[i].base_sha256 == hashlib.sha256(base_spans(x or "").encode()).hexdigest() for i, x in enumerate(ODD))
    assert pii.find_documents(empty).count() == 0
    assert [r.text for r in pii.mask_documents(frame(spark, [None, "x@y.zz"])).orderBy("doc_id").collect()] == [None, "<email>"]


# 9


def brute_winnow(text, k, w):
    codes = np.array([ord(c) for c in text], np.uint32)
    if not len(codes):
        return []
    k = min(k, len(codes))
    h = [int(winnow.rolling(codes[i : i + k], k)[0] >> np.uint64(32)) for i in range(len(codes) - k + 1)]
    w, out = min(w, len(h)), []
    for i in range(len(h) - w + 1):
        low = min(h[i : i + w])
        at = max(j for j in range(i, i + w) if h[j] == low)
        if not out or out[-1] != (low, at):
            out.append((low, at))
    return out


@pytest.mark.parametrize("k,w", [(4, 5), (16, 48), (1, 1), (7, 3)])
def test_winnowing(k, w):
    rng = random.Random(k)
    for n in (0, 1, 3, 7, 40, 200):
        text = "".join(rng.choice("abé😀") for _ in range(n))
        assert [tuple(map(int, p)) for p in winnow.winnow(text, k, w)] == brute_winnow(text, k, w)
    a, b, shared = ("".join(rng.choice("abcdefgh") for _ in range(150)) for _ in range(3))
    assert set(winnow.winnow(a + shared, k, w)[:, 0]) & set(winnow.winnow(b + shared, k, w)[:, 0])


@pytest.mark.parametrize("slices", [1, 3, 8])
def test_next_documents(spark, slices, empty):
    docs = frame(spark, ODD).withColumn("doc_id", F.col("doc_id") * F.col("doc_id") - 5)
    got = {r.doc_id: r for r in winnow.compare_with_next(docs, slices=slices).collect()}
    texts = {i: x or "" for i, x in texts_of(docs).items()}
    order = sorted(texts, reverse=True)
    for i, j in zip(order, order[1:] + order[:1]):
        new = winnow.edited(texts[i], texts[j])
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and got[i].n_chars == len(texts[i])
        assert got[i].edited_fingerprint == winnow.as_text(winnow.winnow(new)) and 0 <= got[i].near_next <= 1
    assert winnow.compare_with_next(empty).count() == 0
    assert winnow.fingerprints(frame(spark, ODD)).count() == len(ODD)


# 10


def brute_components(texts, n, percent):
    sets = {}
    for i, x in texts.items():
        words = (x or "").encode().lower().split()
        sets[i] = frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("crowd", [1, 32])
@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, words, percent, crowd):
    rng = random.Random(percent + crowd)
    base = [[rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(60)] for _ in range(4)]
    texts = list(ODD)
    for _ in range(70):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            t[rng.randint(0, 59)] = "new" + str(rng.randint(0, 5))
        texts.append(" ".join(t) if rng.random() < 0.8 else " ".join(t).upper())
    docs = frame(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(docs, words, percent, crowd).collect()}
    want = brute_components(dict(enumerate(texts)), words, percent)
    assert got == want
    kept = {r.doc_id for r in jaccard.keep_one(docs, words, percent).collect()}
    assert kept == {i for i, (_, c) in want.items() if c == i}


def test_jaccard_edges(spark, empty):
    assert jaccard.link_documents(empty).count() == 0
    again = frame(spark, ["a b c d", "x"]).unionByName(frame(spark, ["a b c d"]))
    assert sorted((r.doc_id, r.component_id) for r in jaccard.link_documents(again).collect()) == [(0, 0), (0, 0), (1, 1)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.node: r.component for r in jaccard.components(links).collect()}
    assert {got.get(i, i) for i in range(41)} == {0} and got[100] == got[95] == 90


def test_packed_sets_compare_as_whole_ones():
    rng = np.random.default_rng(5)
    for n in [1, 2, 9, 50, 300] * 20 + [jaccard.MOST48, jaccard.MOST48 + 2000]:
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        lost = int(rng.integers(0, n // 5 + 1))
        other = np.unique(np.concatenate([base[lost:], rng.integers(0, 2**64, lost // 2, dtype=np.uint64)]))
        same = len(np.intersect1d(base, other))
        for percent in (80, 90, 100):
            assert jaccard.same_enough(jaccard.packed(base), jaccard.packed(other), percent) == (100 * same >= percent * (len(base) + len(other) - same))


@pytest.mark.parametrize("percent", [80, 90, 100])
def test_size_bands_lose_no_pair_that_can_link(spark, percent):
    """Two sizes that can link are at most two bits apart, in a circle of 64."""
    sizes = spark.range(1, 3000).withColumnRenamed("id", "n").select("n", jaccard.size_band(percent).alias("band"))
    bit = {r.n: (r.band & (2**64 - 1)).bit_length() - 1 for r in sizes.collect()}
    for n in bit:
        for m in {n, -(-percent * n // 100), (n + -(-percent * n // 100)) // 2}:
            assert min((bit[n] - bit[m]) % 64, (bit[m] - bit[n]) % 64) <= 2
    rows = spark.createDataFrame([(2, 1 | 1 << 2, 1), (2, 1 | 1 << 3, 1), (2, 1, 1), (2, 1 | -(1 << 63), 1), (3, 1 | 1 << 9 | 1 << 20, 1), (3, 1 | 1 << 9, 1)], "c long, bands long, band long")
    assert [r.ok for r in rows.select(jaccard.meets("band").alias("ok")).collect()] == [True, False, True, True, False, True]
