"""Target encoding, fill-in-middle and HTML extraction against brute force and edge cases."""

import datetime as dt
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import fim, html
from skein.llm.target_encoding import add_history, encode_sales, fold_of

from .test_llm import ODD, frame

# 11

LINES = "sale_id long, line_no int, item_id long, vendor_id long, flag string, p string, hn long, time string"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, status string, fold int"


def shop(spark, lines, sales, items=(), vendors=(), clients=()):
    """Extra columns clash with what the operator adds."""
    return (
        spark.createDataFrame([(*r, "clash", 7, "t") for r in lines], LINES), spark.createDataFrame([(*r, "x", 9) for r in sales], SALES), spark.createDataFrame(list(items), "item_id long, kind string"),
        spark.createDataFrame(list(vendors), "vendor_id long, nation_id int"), spark.createDataFrame(list(clients), "client_id long, segment string"),
    )


def brute_encoding(lines, sales, items, vendors, clients):
    at = {}
    for sale, client, sold in sales:
        if sale is not None and sold is not None:
            at[sale] = min(at.get(sale, (sold, 10**9)), (sold, -1 if client is None else client))
    kind, nation, segment = dict(items), dict(vendors), dict(clients)
    rows = []
    for sale, _, item, vendor, flag in lines:
        if sale in at:
            sold, client = at[sale]
            item = -1 if item is None else item
            keys = {"all": 0, "item": item, "vendor": vendor, "client": client, "kind": kind.get(item), "nation": nation.get(vendor), "segment": segment.get(client)}
            rows.append((sale, item, vendor, sold, zlib.crc32(str(sale).encode()) % 5, flag == "returned", keys))
    out = {}
    for sale, item, vendor, sold, fold, flag, keys in rows:
        key = (sale, item, vendor)
        if key not in out:
            past = [r for r in rows if r[3] < sold and r[4] != fold]
            n = {k: sum(1 for r in past if r[6][k] == v) for k, v in keys.items()}
            s = {k: sum(r[5] for r in past if r[6][k] == v) for k, v in keys.items()}

            def rate(k, p, n=n, s=s):
                return p if n[k] < 1 else (1_000_000 * s[k] + 50 * p) // (n[k] + 50)

            top = rate("all", 500_000)
            out[key] = [0, 0] + [x for k, p in (("item", "kind"), ("vendor", "nation"), ("client", "segment")) for x in (n[k], rate(k, rate(p, top)))]
        out[key][0] += 1
        out[key][1] += flag
    return out


def encoded(tables):
    got = encode_sales(*tables).collect()
    out = {(r.sale_id, r.item_id, r.vendor_id): [r.n_lines, r.n_returned, r.item_n, r.item_rate, r.vendor_n, r.vendor_rate, r.client_n, r.client_rate] for r in got}
    assert len(out) == len(got)
    return out


def test_encoding_equals_brute_force(spark):
    rng, day = random.Random(3), dt.datetime(2024, 1, 1)
    sales = [(k, rng.choice([None, 1, 1, 1, 2, 3, 99]), None if k % 17 == 0 else day + dt.timedelta(hours=rng.randint(0, 40))) for k in range(120)]
    lines = [(rng.choice([0, 1, 2, rng.randint(0, 130)]), k, rng.choice([None, 5, 5, 5, 6, 7, 8]), rng.choice([0, 0, 1, 2, 50]), rng.choice(["returned", "kept", None])) for k in range(700)]
    lines += [(None, 1, 5, 0, "returned"), lines[0], lines[0]]
    sides = [(5, "a"), (6, "a"), (7, None)], [(0, 1), (1, 2), (2, None)], [(1, "x"), (2, None), (3, "y")]
    assert encoded(shop(spark, lines, sales, *sides)) == brute_encoding(lines, sales, *sides)


def test_encoding_of_one_key_one_time_and_nothing(spark):
    day = dt.datetime(2024, 1, 1)
    sales = [(k, 1, day) for k in range(40)]  # all at once: nobody has a history
    lines = [(k % 40, k, 5, 0, "returned") for k in range(200)]
    got = encoded(shop(spark, lines, sales))
    assert got == brute_encoding(lines, sales, (), (), ()) and {tuple(x[2:]) for x in got.values()} == {(0, 500_000) * 3}
    later = [(k, 1, day + dt.timedelta(seconds=k // 9)) for k in range(40)]  # one key over all blocks, ties across their ends
    assert encoded(shop(spark, lines, later)) == brute_encoding(lines, later, (), (), ())
    assert encoded(shop(spark, [], sales)) == encoded(shop(spark, lines, [])) == {}


def test_history_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), int(c), int(d), int(e)) for a, b, c, d, e in zip(rng.integers(0, 3, 3000), rng.integers(0, 60, 3000), rng.integers(0, 5, 3000), rng.integers(1, 4, 3000), rng.integers(0, 2, 3000), strict=True)]
    want = sorted((a, b, c, sum(r[3] for r in rows if r[0] == a and r[1] < b and r[2] != c), sum(r[4] for r in rows if r[0] == a and r[1] < b and r[2] != c)) for a, b, c in {r[:3] for r in rows})
    df = spark.createDataFrame(rows, "k long, time long, fold int, n long, s long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for blocks in (1, 3, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(blocks))
            got = add_history(df, "k", "time", "fold", "n", "s", ["n", "s"], "hn", "hs")[0]
            assert sorted(tuple(r) for r in got.select("k", "time", "fold", "hn", "hs").distinct().collect()) == want
            assert got.count() == 3000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fold_is_crc_of_digits(spark):
    got = spark.range(0, 50).select(fold_of(F.col("id")).alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32(str(k).encode()) % 5 for k in range(50)]


# 12

UNIT = re.compile(r"[^\n]*\n|[^\n]+")
WORD = re.compile(r"[ \t-\r]*[^ \t-\r]+[ \t-\r]*|[ \t-\r]+")


def brute_fim(doc_id, text, unit=UNIT, spm=50, markers=("<P>", "<S>", "<M>")):
    text = text or ""
    units = unit.findall(text)
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or doc_id is None or any(m in text for m in markers):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    out = f"{markers[0]}{p}{markers[1]}{s}{markers[2]}{m}" if form == "psm" else f"{markers[1]}{s}{markers[0]}{p}{markers[2]}{m}"
    return n, form, len(p), len(m), out


FIM_TEXTS = [*ODD, "a <P> b\nc", "x<S", "<M", "\n", "\n\n\n", "no end", "end\n", "\na", "é\n😀\n" * 300, "line\n" * 5000, "ab\n" * 40000 + "tail", "y" * 200_000, "z" * 65_536, "z" * 65_535 + "\n" + "q"]


@pytest.mark.parametrize("piece", [7, 256, 65_536])
def test_fim_equals_brute_force(spark, piece):
    texts = [x for x in FIM_TEXTS if piece > 7 or len(x or "") < 3000]
    docs = frame(spark, texts).unionByName(frame(spark, texts))  # every row twice
    got = fim.transform(docs, piece=piece).withColumn("back", fim.restored(F.col("form"), F.col("output"))).collect()
    want = {i: brute_fim(i, x) for i, x in enumerate(texts)}
    assert len(got) == 2 * len(texts)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want[r.doc_id] and r.back == (texts[r.doc_id] or "")


def test_fim_words_rates_and_nulls(spark):
    texts = [" a bc  d\te\n", "one", "  ", "w " * 3000, "x y"]
    got = {r.doc_id: r for r in fim.transform(frame(spark, texts), automaton=fim.WORDS, spm_percent=0, piece=64).collect()}
    for i, x in enumerate(texts):
        r = got[i]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(i, x, WORD, 0)
    assert {r.form for r in fim.transform(frame(spark, texts), fim_percent=0).collect()} == {"plain"}
    assert [tuple(r) for r in fim.transform(spark.createDataFrame([(None, "a\nb")], "doc_id long, text string")).collect()] == [(None, 2, "plain", None, None, "a\nb")]
    assert fim.transform(frame(spark, [])).count() == 0


def test_scan_composes_from_every_state():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.choice([0, 1, 255, 256, 257, 1500]))) for _ in range(40)]
    for automaton in (fim.LINES, fim.WORDS):
        step, begins = automaton.tables()
        scan = fim.Scan(texts, automaton)
        to, count = scan.functions()
        for i, x in enumerate(texts):
            for q in range(step.shape[1]):
                state, places = q, []
                for at, c in enumerate(automaton.classes(np.array([ord(z) for z in x], np.uint32)).astype(int)):
                    if begins[c, state]:
                        places.append(at)
                    state = step[c, state]
                assert (to[i, q], count[i, q]) == (state, len(places))
                skips = np.arange(len(places) + 2)
                assert scan.find(np.full(len(skips), i), np.full(len(skips), q), skips).tolist() == [*places, len(x), len(x)]


# 13

PAGE = "<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body class='has-sidebar'><header><h2>site</h2></header><nav><ul><li><a href=/>home</a></ul></nav>%s<aside>side</aside><footer>foot</footer></body></html>"


def texts_of_pages(spark, pages):
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, text string, slot int")
    rows = html.extract(df).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    return [r.text for r in sorted(rows, key=lambda r: r.page_id)]


def test_article_alone(spark):
    body = "<article><h1>T &amp;amp; t</h1><p>a\n  <b>b<i>c</i><br>d<p>e&nbsp;f<ul><li>g<li>h</ul><script>var x='</p>'</script><div class='share'>no</div><div class='comments'><p>no</p></div><form>no</form><p>z</article><div class=ad>no</div>"
    assert texts_of_pages(spark, [("http://a.b/1", PAGE % body)]) == ["T &amp; t\na bc d\ne f\ng\nh\nz"]


def test_wrapper_drops_what_never_changes(spark):
    pages = [("http://h.x/%d" % k, PAGE % f"<div class=body><p>Read more stories here</p><h1>t{k}</h1>{'<p>word %d' % k * (k + 1)}<ul><li><a href=/q>to {k}</a></ul></div>") for k in range(8)]
    got = texts_of_pages(spark, pages)
    assert got == ["\n".join([f"t{k}", *[f"word {k}"] * (k + 1)]) for k in range(8)]
    assert texts_of_pages(spark, [(None, h) for _, h in pages])[0] == "Read more stories here\nt0\nword 0\nto 0"  # no host, no wrapper


def test_copies_keep_their_text(spark):
    page = PAGE % "<article><h1>t</h1><p>the same on every page</p></article>"
    assert texts_of_pages(spark, [("http://h.x/", page)] * 30) == ["t\nthe same on every page"] * 30
    near = [("http://h.x/", PAGE % f"<article><h1>the same title</h1><p>the same long paragraph on every page</p><p>only {k} varies</p></article>") for k in range(9)]
    assert texts_of_pages(spark, near)[4] == "the same title\nthe same long paragraph on every page\nonly 4 varies"


def test_odd_pages(spark):
    odd = [None, "", "   ", "no markup at all", "<p>cut <b", "<article>" * 3000 + "deep" + "</article>" * 10, "<p>&#xD800; &#65; &copy x &unknown;</p>", "<!-- open", "<article></article><p>outside", "<p>" + "long " * 50_000 + "</p>", "<main><p>m</p></main><p>o", "<noscript>n</noscript><p hidden>h</p><p style='display: none'>s</p>v"]
    got = texts_of_pages(spark, [("http://o.d/", h) for h in odd])
    assert got == ["", "", "", "no markup at all", "cut", "deep", "� A © x &unknown;", "", "outside", ("long " * 50_000).strip(), "m", "v"]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_matching_is_the_best_alignment():
    rng = random.Random(2)

    def grown(depth):
        label = rng.choice("abc")
        return (label, [grown(depth - 1) for _ in range(rng.randint(0, 3))] if depth else [])

    def written(t):
        return ";".join([f"{t[0]} {len(t[1])}", *(written(c) for c in t[1])])

    def best(x, y):
        if x[0] != y[0]:
            return 0
        m = [[0] * (len(y[1]) + 1) for _ in range(len(x[1]) + 1)]
        for i, p in enumerate(x[1]):
            for j, q in enumerate(y[1]):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + best(p, q))
        return 1 + m[-1][-1]

    for _ in range(200):
        a, b = ("r", [grown(2) for _ in range(3)]), ("r", [grown(2) for _ in range(3)])
        got = html.matching(written(a), written(b))
        labels_a, labels_b = html.unfolded(written(a))[0], html.unfolded(written(b))[0]
        matched = [(i, j) for i, j in enumerate(got) if j >= 0]
        assert all(labels_a[i] == labels_b[j] for i, j in matched) and len({j for _, j in matched}) == len(matched) == best(a, b)
        assert [j for _, j in matched] == sorted(j for _, j in matched)
