"""The thin queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digest_documents

    return digest_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_documents

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import BY_LENGTH, deduplicated

    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), BY_LENGTH, every_repeat=True)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lines_repeated", "lines_near", F.length(text).cast("long").alias("chars_left"), F.sha2(text, 256).alias("text_sha256"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict_documents

    docs = table(spark, sf_dir, "documents")
    return predict_documents(docs, fit(docs))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_document_tokens

    return count_document_tokens(spark, table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_documents

    return find_documents(table(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnow import compare_with_next

    return compare_with_next(table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import link_documents

    return link_documents(table(spark, sf_dir, "documents"))


def op11_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .target_encoding import encode_sales

    return encode_sales(*(table(spark, sf_dir, t) for t in ("sale_lines", "sales", "items", "vendors", "clients")))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import restored, transform

    out = transform(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_toxicity, op3_packing, op4_lines, op5_ann, op6_langid, op7_token_counts, op8_pii, op9_winnowing, op10_jaccard, op11_target_encoding, op12_fim, op13_html)}
#: Equal lines stay once, and none of 20 code points and more that is near an earlier one: 1 edit from 20 code points of the
#: shorter line on, 2 from 256, 3 from 512, 4 from 1,024. levenshtein counts bytes here: where a pair is not all ASCII, the
#: code points that both lines have are written as one byte each, and any other as one that the other line lacks.
LINES_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), c AS (SELECT line, length(line) AS n, min({'d': doc_id, 'p': pos}) AS at FROM l WHERE line <> '' GROUP BY line),
f AS (
  SELECT *, CASE WHEN n >= 1024 THEN 4 WHEN n >= 512 THEN 3 WHEN n >= 256 THEN 2 ELSE 1 END AS e,
    n - length(replace(line, 'e', '')) AS c1, n - length(replace(line, 'n', '')) AS c2, n - length(replace(line, 't', '')) AS c3,
    n - length(replace(line, 'a', '')) AS c4, n - length(replace(line, ' ', '')) AS c5, n - length(replace(line, 'o', '')) AS c6
  FROM c WHERE n >= 20
), s AS (SELECT *, unnest(range(n, n + e + 1)) AS m FROM f),
p AS (
  SELECT s.line AS x, f.line AS y, s.e, s.at AS ax, f.at AS ay FROM s JOIN f ON s.m = f.n AND s.line <> f.line
    AND abs(s.c1 - f.c1) + abs(s.c2 - f.c2) + abs(s.c3 - f.c3) + abs(s.c4 - f.c4) + abs(s.c5 - f.c5) + abs(s.c6 - f.c6) <= 2 * s.e
), q AS (
  SELECT CASE WHEN ax < ay THEN y ELSE x END AS later, x, y, e, levenshtein(x, y) AS b,
    list_intersect(string_split(x, ''), string_split(y, '')) AS shared
  FROM p WHERE levenshtein(x, y) <= 4 * e
), g AS (
  SELECT DISTINCT later FROM q WHERE CASE WHEN b <= e THEN true WHEN strlen(x) = length(x) AND strlen(y) = length(y) THEN false
    ELSE levenshtein(array_to_string(list_transform(string_split(x, ''), lambda a: chr(coalesce(list_position(shared, a), 0)::INT + 2)), ''),
      array_to_string(list_transform(string_split(y, ''), lambda a: chr(CASE WHEN list_contains(shared, a) THEN list_position(shared, a)::INT + 2 ELSE 1 END)), '')) <= e END
), d AS (
  SELECT l.doc_id, l.pos, l.line, c.line IS NOT NULL AND (g.later IS NOT NULL OR {'d': l.doc_id, 'p': l.pos} <> c.at) AS gone,
    c.line IS NOT NULL AND g.later IS NOT NULL AND {'d': l.doc_id, 'p': l.pos} = c.at AS near
  FROM l LEFT JOIN c ON l.line = c.line LEFT JOIN g ON l.line = g.later
), r AS (
  SELECT doc_id, count(*) FILTER (gone AND NOT near) AS lines_repeated, count(*) FILTER (near) AS lines_near,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS t FROM d GROUP BY doc_id
)
SELECT doc_id, lines_repeated, lines_near, length(t) AS chars_left, sha256(t) AS text_sha256 FROM r
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w
), k AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
t AS (SELECT rep, n, unnest(g) AS x FROM k),
i AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS same FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.rep, b.rep),
e AS (SELECT a, b FROM i WHERE 100 * same >= 90 * (na + nb - same)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT rep, rep FROM k UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN k ON s.g = k.g LEFT JOIN m ON k.rep = m.a
"""

#: Windows over all rows of a value less those over its rows of the same fold. CRC-32 goes by the byte, from a table.
TARGET_SQL = """
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
f AS (
  SELECT sale_id, sold_at, coalesce(client_id, -1) AS client_id,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda b: ascii(b)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 5 AS fold
  FROM sales, c WHERE sold_at IS NOT NULL
), l AS (
  SELECT f.*, coalesce(l.item_id, -1) AS item_id, l.vendor_id, (l.flag = 'returned')::INT AS r, kind, v.nation_id AS nation, segment
  FROM sale_lines l JOIN f USING (sale_id) LEFT JOIN items i ON coalesce(l.item_id, -1) = i.item_id LEFT JOIN vendors v ON l.vendor_id = v.vendor_id LEFT JOIN clients k ON f.client_id = k.client_id
), h AS (
  SELECT *, {columns} FROM l
), a AS (SELECT *, CASE WHEN all_n < 1 THEN 500000 ELSE (1000000 * all_s + 50 * 500000) // (all_n + 50) END AS p FROM h),
q AS (SELECT *, {priors} FROM a)
SELECT sale_id, item_id, vendor_id, count(*) AS n_lines, sum(r)::BIGINT AS n_returned, {rates} FROM q GROUP BY sale_id, item_id, vendor_id
"""


def target_sql() -> str:
    keys = {"all": [], "kind": ["kind"], "nation": ["nation"], "segment": ["segment"], "item": ["item_id"], "vendor": ["vendor_id"], "client": ["client_id"]}

    def window(what: str, by: list[str]) -> str:
        return f"coalesce({what} OVER (PARTITION BY {', '.join(by) or '1'} ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0)"

    def smooth(name: str, prior: str) -> str:
        return f"CASE WHEN {name}_n < 1 THEN {prior} ELSE (1000000 * {name}_s + 50 * {prior}) // ({name}_n + 50) END"

    columns = ", ".join(f"({window(w, k)} - {window(w, [*k, 'fold'])})::BIGINT AS {name}_{c}" for name, k in keys.items() for c, w in (("n", "count(*)"), ("s", "sum(r)")))
    priors = ", ".join(f"{smooth(k, 'p')} AS {k}_p" for k in ("kind", "nation", "segment"))
    rates = ", ".join(f"any_value({k}_n) AS {k}_n, any_value({smooth(k, p + '_p')})::BIGINT AS {k}_rate" for k, p in (("item", "kind"), ("vendor", "nation"), ("client", "segment")))
    return TARGET_SQL.replace("{columns}", columns).replace("{priors}", priors).replace("{rates}", rates)


FIM_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR coalesce(h3 % 100 >= 100, true) THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), x AS (
  SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS p, coalesce(array_to_string(l[a + 1:b], ''), '') AS m, coalesce(array_to_string(l[b + 1:n], ''), '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM x
"""

ORACLES: dict[str, str] = {"op4_lines": LINES_SQL, "op10_jaccard": JACCARD_SQL, "op11_target_encoding": target_sql(), "op12_fim": FIM_SQL}
