"""The pipeline's stages, each on its own input, and the whole."""

import corpus_pipeline as p
from skein.llm import lines, toxicity

from .test_lines import steps_of
from .test_llm import brute_components, brute_lines, edits, frame, texts_of

D = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "lines", "near_duplicates", "pii", "packing"]
    model = toxicity.fit(docs, spark.read.parquet(f"{D}/labels.parquet"))
    score = toxicity.scorer(model)
    before = texts_of(docs)
    clean = p.drop_toxic(spark, docs, D)
    assert clean.columns == docs.columns and set(texts_of(clean)) == {i for i, x in before.items() if score(x) < 0.7}
    lined = p.drop_lines(spark, clean, D)
    want = brute_lines_fast(texts_of(clean))
    assert lined.columns == docs.columns and texts_of(lined) == {i: x for i, x in want.items() if x.strip() or x == texts_of(clean)[i]}
    near = p.drop_near_duplicates(spark, lined, D)
    parts = brute_components(texts_of(lined), 5, 80)
    assert near.columns == docs.columns and set(texts_of(near)) == {i for i, (_, c) in parts.items() if c == i}
    masked = p.mask_pii(spark, near, D)
    assert masked.columns == docs.columns and all(r.n_chars == len(r.text) for r in masked.collect())
    assert set(r.doc_id for r in p.pack(spark, masked, D).collect()) == set(texts_of(masked))


def brute_lines_fast(docs):
    """The rule of lines.BY_LENGTH by plain tables of distances, for pairs whose lengths and letters can be near."""
    from collections import Counter, defaultdict

    first = {}
    for i in sorted(docs):
        for k, x in enumerate((docs[i] or "").split("\n")):
            first.setdefault(x, (i, k))
    long = {x: Counter(x) for x in first if len(x) >= 20}
    by_length = defaultdict(list)
    for x in long:
        by_length[len(x)].append(x)
    gone = set()
    for x, own in long.items():
        most = steps_of(len(x))
        for n in range(len(x), len(x) + most + 1):
            for y in by_length[n]:
                if x != y and sum(((own - long[y]) + (long[y] - own)).values()) <= 2 * most and edits(x, y) <= most:
                    gone.add(max(x, y, key=first.get))
    return {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if not x or x not in gone and first[x] == (i, k)) for i, t in docs.items()}


def test_run(spark):
    assert p.run(spark, D).count() > 0


def test_stages_on_empty_and_odd_rows(spark):
    docs = frame(spark, [None, "", "a line that is long enough\nb", "a line that is long enough\nc", "x@y.org"], extra=False)
    out = docs
    for _, f in p.STAGES[1:-1]:
        out = f(spark, out, D)
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3, 4]
    assert brute_lines({0: "q"}, 1, 20) == {0: "q"} and lines.ALPHABET


def test_repeated_and_missing_ids(spark):
    from skein.llm import jaccard

    x, y, z = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen fifteen", "quite another text that nobody else has here"
    rows = [(3, x), (5, x), (5, y), (9, y), (None, x), (None, z), (None, z), (1, z + " a"), (1, z + " a"), (7, ""), (7, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, node int, digest string")
    kept = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(docs, 5, 85).collect()), key=repr)
    assert kept == sorted([(3, x), (5, y), (None, z), (1, z + " a"), (7, ""), (7, ""), (8, None)], key=repr)
    assert jaccard.keep_one(docs, 5, 80).columns == docs.columns
    near = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(docs, 5, 80).collect()), key=repr)
    assert near == sorted([(3, x), (5, y), (1, z + " a"), (7, ""), (7, ""), (8, None)], key=repr)
    # ids are one document each: 3 - 5 by x, 5 - 9 by y
    got = sorted((tuple(r) for r in jaccard.link_documents(docs, 5, 80).collect()), key=repr)
    want = [(3, 4, 3), (5, 4, 3), (5, 3, 3), (9, 3, 3), (None, 4, None), (None, 4, None), (None, 4, None), (1, 5, 1), (1, 5, 1), (7, 0, 7), (7, 0, 7), (8, 0, 8)]
    assert got == sorted(want, key=repr)
    assert jaccard.keep_one(docs.limit(0)).count() == 0 and jaccard.link_documents(docs.limit(0)).count() == 0


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{D}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
