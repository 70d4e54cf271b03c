"""Shared SQL for the checks: logical tables over the given ones, written independently of Spark."""

from __future__ import annotations

from refrain.config import SOURCE_ORDER, SOURCE_WEIGHTS
from refrain.functions.text import STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9'']+')"


def tokens(x: str) -> str:
    return f"list_sort(list_distinct(list_filter({words(x)}, lambda t: length(t) > 2 and t not in ({_STOP}))))"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / (case when sqrt(list_inner_product({v}, {v})) = 0 then 1.0 else sqrt(list_inner_product({v}, {v})) end))"


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def inter(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def jaccard(a: str, b: str) -> str:
    """Both sides are sets."""
    return f"(case when len({a}) + len({b}) > 0 then {inter(a, b)}::double / (len({a}) + len({b}) - {inter(a, b)}) else 0.0 end)"


def spaced(x: str) -> str:
    return f"coalesce(array_to_string({x}, ' '), '')"


def meta(titled: bool) -> str:
    head = "[track_name[1], artist_name[1], album_name[1]]" if titled else "[artist_name[1], album_name[1]]"
    return f"array_to_string(list_filter(list_concat({head}, tag_list[1:8]), lambda p: p is not null and p <> ''), ' ')"


ITEM_TEXT = ("track_name[1] || ' by ' || array_to_string(artist_name, ', ') || '. Album: ' || album_name[1] "
             "|| '. Tags: ' || array_to_string(tag_list[1:10], ', ')")
SHORT_REF = "track_name[1] || ' by ' || artist_name[1]"
DOC_TEXT = f"concat_ws(' ', {spaced('track_name')}, {spaced('artist_name')}, {spaced('album_name')}, {spaced('tag_list')})"

CTES: dict[str, str] = {}
NEEDS: dict[str, list[str]] = {}


def cte(name: str, body: str, needs: str = "") -> None:
    CTES[name] = body
    NEEDS[name] = needs.split()


def q(needs: str, body: str) -> str:
    """SQL text with the common tables ``body`` needs, in dependency order."""
    done: list[str] = []

    def visit(n: str) -> None:
        for m in NEEDS[n]:
            visit(m)
        if n not in done:
            done.append(n)
    for n in needs.split():
        visit(n)
    if not done:
        return body
    body = body.strip()
    head = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in done)
    return head + ",\n" + body[5:] if body.startswith("WITH ") else head + "\n" + body


cte("items", """
SELECT cast(p_partkey AS varchar) AS item_id, [p_name] AS track_name, [p_brand] AS artist_name, [p_type] AS album_name,
  CASE WHEN p_size > 25 THEN [p_type || '-' || p_size] ELSE [] END AS album_id,
  list_concat(string_split(p_name, ' '), [lower(p_type), cast(p_size % 10 AS varchar) || '0s', 'size ' || p_size, ' ' || p_type]) AS tag_list,
  CASE WHEN p_size <> 17 THEN cast(1950 + p_size AS varchar) || '-06-01' END AS release_date,
  cast(floor(p_retailprice * 200) AS bigint) AS duration,
  round(p_retailprice - 100 * floor(p_retailprice / 100), 2) AS popularity
FROM part""")
cte("all_plays", """
SELECT cast(o_custkey AS varchar) AS case_id, cast(l_partkey AS varchar) AS item_id,
  row_number() OVER w AS pos, count(*) OVER (PARTITION BY o_custkey) AS pos_total
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
cte("plays", "SELECT case_id, item_id, pos, pos_total - 1 AS pos_total FROM all_plays WHERE pos < pos_total", "all_plays")
cte("gold", "SELECT case_id, item_id FROM all_plays WHERE pos = pos_total", "all_plays")
cte("cases", """
SELECT cast(c_custkey AS varchar) AS case_id,
  coalesce('please give me ' || p_name || ' for ' || c_mktsegment, c_mktsegment) AS user_query
FROM customer LEFT JOIN part ON p_partkey = c_custkey""")
cte("base_turns", """
SELECT conv_id, turn, role, text,
  cast(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS bigint) AS tn,
  cast(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER w AS bigint) AS na
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
cte("turns", """
SELECT cast(conv_id AS varchar) AS session_id, CASE WHEN conv_id % 3 <> 0 THEN 'u' || conv_id END AS user_id,
  2 * turn AS pos, cast(tn AS int) AS turn_number, role, text AS content FROM base_turns
UNION ALL
SELECT cast(conv_id AS varchar), CASE WHEN conv_id % 3 <> 0 THEN 'u' || conv_id END,
  2 * turn + 1, cast(tn AS int), 'music', ' ' || p.item_id || ' '
FROM base_turns b JOIN plays p ON p.case_id = cast(conv_id AS varchar) AND p.pos = b.na WHERE b.role = 'assistant'""",
    "plays base_turns")
cte("last_req", """
SELECT session_id, turn_number, content AS user_query FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_number DESC, pos DESC) AS r FROM turns WHERE role = 'user') WHERE r = 1""",
    "turns")
cte("said", """
SELECT cast(conv_id AS varchar) AS case_id, text AS content,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS is_last
FROM conversations WHERE role = 'user'""")
cte("dev_cases", """
SELECT u.session_id, u.user_id, u.turn_number, u.pos, u.content AS user_query,
  u.session_id || ':' || u.turn_number || ':' || u.pos AS case_id, g.gt,
  (SELECT count(*) FROM turns t WHERE t.session_id = u.session_id AND t.role = 'music' AND t.turn_number < u.turn_number) AS n_prior_music,
  (SELECT count(*) FROM turns t WHERE t.session_id = u.session_id AND t.role = 'user' AND t.turn_number < u.turn_number) AS n_prior_user
FROM turns u JOIN (SELECT session_id, turn_number, arg_max(trim(content), pos) AS gt FROM turns WHERE role = 'music' GROUP BY 1, 2) g
  ON g.session_id = u.session_id AND g.turn_number = u.turn_number
WHERE u.role = 'user'""", "turns")
for space, sl in {"vmeta": "[1:64]", "vcollab": "[1:32]", "vaudio": "[33:64]"}.items():
    v = f"cast(embedding AS double[]){sl}"
    cte(space, f"SELECT cast(vec_id AS varchar) AS item_id, {unit(v)} AS vec FROM embeddings WHERE len(embedding) = 64")
cte("factors", "SELECT cast(vec_id AS varchar) AS item_id, cast(embedding AS double[]) AS vec FROM embeddings WHERE len(embedding) = 64")
cte("vfold", "SELECT cast(vec_id AS varchar) AS item_id, f AS fold, "
    + unit("cast(embedding AS double[])[1 + 12 * f : 16 + 12 * f]") + " AS vec FROM embeddings, range(5) r(f) WHERE len(embedding) = 64")


def ranked(src: str, k: int, key: str = "case_id") -> str:
    return (f"SELECT * REPLACE (round(score, 6) AS score) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, item_id) AS rank "
            f"FROM ({src})) WHERE rank <= {k}")


def max_recent(space: str, last: int, k: int) -> str:
    return ranked(f"""
SELECT a.case_id, v.item_id, max(round({dot('av.vec', 'v.vec')}, 12)) AS score
FROM (SELECT DISTINCT case_id, item_id FROM plays WHERE pos > pos_total - {last}) a
JOIN {space} av ON av.item_id = a.item_id CROSS JOIN {space} v
WHERE NOT EXISTS (SELECT 1 FROM plays x WHERE x.case_id = a.case_id AND x.item_id = v.item_id AND x.pos > x.pos_total - {last})
GROUP BY 1, 2""", k)


def neighbours(space: str, k: int) -> str:
    return ranked(f"""
SELECT a.case_id, v.item_id, round({dot('av.vec', 'v.vec')}, 12) AS score
FROM plays a JOIN {space} av ON av.item_id = a.item_id CROSS JOIN {space} v
WHERE a.pos = a.pos_total AND v.item_id <> a.item_id""", k)


def bm25(parts: str, docs: str, k: int) -> str:
    """``parts``: query_id, text, times. ``docs``: item_id, text."""
    return f"""
WITH d AS MATERIALIZED (SELECT item_id, {words('text')} AS ws FROM ({docs}) x), dw AS (SELECT item_id, len(ws) AS dl, unnest(ws) AS term FROM d),
post AS (SELECT item_id, dl, term, count(*) AS tf FROM dw GROUP BY ALL),
st AS (SELECT count(*) AS n, sum(len(ws))::double / count(*) AS avgdl FROM d),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
qd AS MATERIALIZED (SELECT query_id, times, {words('text')} AS ws FROM ({parts}) p), qw AS (SELECT query_id, times, unnest(ws) AS term FROM qd),
qt AS (SELECT query_id, term, sum(times)::double AS qtf FROM qw GROUP BY ALL),
sc AS (SELECT query_id, item_id, sum(round(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) * 1e12)::BIGINT) / 1e12 AS score
  FROM qt JOIN dfs USING (term) JOIN post USING (term) CROSS JOIN st GROUP BY ALL)
SELECT query_id, item_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM sc) WHERE rank <= {k}"""


cte("last_parts", f"""
SELECT c.case_id AS query_id, coalesce(nullif({meta(True)}, ''), c.user_query) AS text, 1 AS times
FROM cases c LEFT JOIN (SELECT * FROM plays WHERE pos = pos_total) p USING (case_id) LEFT JOIN items i USING (item_id)""", "cases plays items")
cte("convo_parts", f"""
SELECT case_id AS query_id, content AS text, CASE WHEN is_last THEN 2 ELSE 1 END AS times FROM said SEMI JOIN cases USING (case_id)
UNION ALL SELECT case_id, user_query, 3 FROM cases
UNION ALL SELECT case_id, {meta(False)}, 1 FROM plays JOIN items USING (item_id)""", "said cases plays items")


def session_vecs(newest: bool, normalize: bool) -> str:
    e = "n - rn" if newest else "rn - 1"
    vec = unit("v") if normalize else "v"
    return f"""
WITH k AS (SELECT case_id, p.item_id, f.vec, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS rn,
  count(*) OVER (PARTITION BY case_id) AS n FROM plays p JOIN factors f ON f.item_id = p.item_id),
w AS (SELECT *, pow(0.8, {e}) AS w FROM k),
d AS (SELECT case_id, w, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS i FROM w),
s AS (SELECT case_id, i, sum(w * x) / sum(w) AS x FROM d GROUP BY 1, 2),
l AS (SELECT case_id, list(x ORDER BY i) AS v FROM s GROUP BY 1)
SELECT case_id, {vec} AS vec FROM l WHERE sqrt(list_inner_product(v, v)) >= 1e-8"""


cte("svec", session_vecs(False, True), "plays factors")


def masked(queries: str, space: str, k: int, mask: bool = True) -> str:
    anti = "WHERE NOT EXISTS (SELECT 1 FROM plays x WHERE x.case_id = s.case_id AND x.item_id = v.item_id)" if mask else ""
    return ranked(f"SELECT s.case_id, v.item_id, round({dot('s.vec', 'v.vec')}, 12) AS score FROM {queries} s CROSS JOIN {space} v {anti}", k)


cte("lastvec", "SELECT case_id, v.vec FROM plays JOIN vcollab v USING (item_id) WHERE pos = pos_total", "plays vcollab")


def ensemble(k: int, mask: bool) -> str:
    anti = "WHERE NOT EXISTS (SELECT 1 FROM plays x WHERE x.case_id = p.case_id AND x.item_id = v.item_id)" if mask else ""
    return ranked(f"""
SELECT case_id, item_id, round(sum(s) / 5, 12) AS score FROM (
  SELECT p.case_id, v.item_id, v.fold, {dot('a.vec', 'v.vec')} AS s
  FROM (SELECT * FROM plays WHERE pos = pos_total) p JOIN vfold a ON a.item_id = p.item_id JOIN vfold v ON v.fold = a.fold {anti})
GROUP BY 1, 2""", k)


_SRC = {
    "qwen_recent": max_recent("vmeta", 3, 100),
    "bm25_lastmusic": "SELECT query_id AS case_id, item_id, score, rank FROM (" + bm25("SELECT * FROM last_parts", f"SELECT item_id, {DOC_TEXT} AS text FROM items", 100) + ")",
    "bm25_convo": "SELECT query_id AS case_id, item_id, score, rank FROM (" + bm25("SELECT * FROM convo_parts", f"SELECT item_id, {DOC_TEXT} AS text FROM items", 100) + ")",
    "qwen_neighbors": neighbours("vmeta", 100),
    "cfbpr_recent": max_recent("vcollab", 3, 100),
    "als_session": masked("svec", "factors", 200),
    "text_retriever": masked("lastvec", "vcollab", 300),
    "struct_base": ensemble(300, True),
    "struct_large": ensemble(300, False),
    "clap_recent": max_recent("vaudio", 3, 100),
}
SOURCE_NEEDS = "plays items cases last_parts convo_parts vmeta vcollab vaudio factors svec lastvec vfold"
cte("cands", "\nUNION ALL ".join(
    f"SELECT case_id, '{s}' AS source, {i} AS source_ord, cast(rank AS int) AS rank, item_id, score FROM ({_SRC[s]})"
    for i, s in enumerate(SOURCE_ORDER)), SOURCE_NEEDS)
SOURCE_SQL = _SRC
# The lists of the offline matrices: last five plays, 200 and 500 long, no audio; ``nvec`` weighs the newest play most.
_LONG = {
    "qwen_recent": max_recent("vmeta", 5, 200),
    "bm25_lastmusic": _SRC["bm25_lastmusic"].replace("rank <= 100", "rank <= 500"),
    "bm25_convo": _SRC["bm25_convo"].replace("rank <= 100", "rank <= 500"),
    "qwen_neighbors": neighbours("vmeta", 200),
    "cfbpr_recent": max_recent("vcollab", 5, 200),
    "als_session": masked("nvec", "factors", 200),
    "text_retriever": masked("lastvec", "vcollab", 200),
}
TRAINING_SQL = "\nUNION ALL ".join(
    f"SELECT case_id, '{s}' AS source, {i} AS source_ord, cast(rank AS int) AS rank, item_id, score FROM ({_LONG.get(s, _SRC[s])})"
    for i, s in enumerate(SOURCE_ORDER) if s != "clap_recent")


def rrf(src: str, k: int = 300, weights: dict | None = None, extra: str = "") -> str:
    w = weights or SOURCE_WEIGHTS
    case = "CASE source " + " ".join(f"WHEN '{s}' THEN {float(x)}" for s, x in w.items()) + " ELSE 0.0 END"
    return f"""
SELECT case_id, item_id, rrf, row_number() OVER (PARTITION BY case_id ORDER BY rrf DESC, so, sr) AS pool_pos FROM (
  SELECT case_id, item_id, round(sum(w / (20 + rank)), 12) AS rrf, min(source_ord) AS so, arg_min(rank, source_ord * 100000 + rank) AS sr
  FROM (SELECT *, {case} AS w FROM {src} {extra}) WHERE w <> 0 GROUP BY 1, 2)
QUALIFY pool_pos <= {k}"""


cte("pool", rrf("cands"), "cands")
# A cheaper pool for the ranking operators: what each customer bought, best price first.
cte("scored", """
SELECT case_id, item_id, pool_pos, s_base, s_large, s_second FROM (
  SELECT cast(o_custkey AS varchar) AS case_id, cast(l_partkey AS varchar) AS item_id,
    row_number() OVER (PARTITION BY o_custkey ORDER BY max(l_extendedprice) DESC, cast(l_partkey AS varchar)) AS pool_pos,
    round(max(l_extendedprice) / 5000, 6) AS s_base, round(max(l_quantity) / 7, 6) AS s_large,
    CASE WHEN max(l_discount) > 0.08 THEN 'NaN'::double ELSE round(max(l_discount) * max(l_tax) * 100, 4) END AS s_second
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey) WHERE pool_pos <= 300""")
cte("returned", """
SELECT DISTINCT cast(o_custkey AS varchar) AS case_id, cast(l_partkey AS varchar) AS item_id
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""")
cte("sess_folds", """
SELECT session_id, cast((row_number() OVER (ORDER BY md5('0:' || session_id)) - 1) % 5 AS int) AS fold
FROM (SELECT DISTINCT session_id FROM dev_cases)""", "dev_cases")
cte("cust_folds", """
SELECT case_id AS session_id, cast((row_number() OVER (ORDER BY md5('0:' || case_id)) - 1) % 5 AS int) AS fold FROM cases""", "cases")
cte("feats", f"""
SELECT item_id, trim(lower(coalesce(array_to_string(artist_name, chr(31)), ''))) AS artist_key,
  list_sort(list_distinct(list_filter(list_transform(tag_list, lambda t: lower(trim(t))), lambda t: t <> ''))) AS tags,
  {tokens(spaced('track_name'))} AS title_toks, {tokens(spaced('artist_name'))} AS artist_toks,
  {tokens("concat_ws(' ', " + ', '.join([spaced('track_name'), spaced('artist_name'), spaced('album_name'), spaced('tag_list[1:12]')]) + ')')} AS meta_toks,
  coalesce(album_id[1], album_name[1], '') AS album_key FROM items""", "items")


def encoded(texts: str, corpus: str, width: int = 256) -> str:
    """``texts``: id, text; ``corpus``: id, text. Unit TF-IDF over hashed terms: id, dim, x (zeros left out)."""
    def counts(src: str) -> str:
        return (f"SELECT id, cast('0x' || left(md5(term), 8) AS bigint) % {width} AS dim, count(*) AS tf "
                f"FROM (SELECT id, unnest({words('text')}) AS term FROM ({src}) x) y GROUP BY 1, 2")
    return f"""
WITH cb AS ({counts(corpus)}), tb AS ({counts(texts)}), df AS (SELECT dim, count(*) AS df FROM cb GROUP BY 1),
w AS (SELECT id, dim, tf * ln(((SELECT count(*) FROM ({corpus}) z) + 1.0) / (coalesce(df, 0) + 1.0)) AS w FROM tb LEFT JOIN df USING (dim)),
n AS (SELECT id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1)
SELECT id, cast(dim AS integer) AS dim, w / n AS x FROM w JOIN n USING (id) WHERE w <> 0"""
