"""DuckDB statements that compute the registered queries from the same tables."""

from lodestone.functions.text import STOP_WORDS

QUERY = "Which texts are released under the MIT License?"
PART_QUERY = "red widget promo"

_STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _stem(t):
    return (
        f"CASE WHEN strlen({t}) > 4 AND ends_with({t}, 'ies') THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN strlen({t}) > 4 AND (ends_with({t}, 'ses') OR ends_with({t}, 'xes') OR ends_with({t}, 'zes') "
        f"OR ends_with({t}, 'hes')) THEN left({t}, length({t}) - 2) "
        f"WHEN strlen({t}) > 3 AND ends_with({t}, 's') AND NOT ends_with({t}, 'ss') "
        f"THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def _words(x):
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{Nd}}]+')"


def _toks(x):
    return (
        f"list_transform(list_filter({_words(x)}, lambda w: strlen(w) >= 2 AND NOT list_contains({_STOP_LIST}, w)), "
        f"lambda t: {_stem('t')})"
    )


def _pairs(terms):
    return f"list_transform(range(1, len({terms})), lambda i: {terms}[i] || {terms}[i + 1])"


_FUSED_LEN = "CASE WHEN len(terms) > 0 THEN len(terms) + 0.5 * (len(terms) - 1) ELSE 0.0 END"

_DOCS = f"""SELECT doc_id, source || '|' || lang || '.d' || doc_id AS node_key, source AS module_dir,
  lang || '.d' || doc_id AS address, lang AS type, 'd' || doc_id AS name, text AS body,
  CASE WHEN n_chars < 200 THEN 'import' ELSE 'resource' END AS kind,
  CASE WHEN lang = 'de' THEN 'examples/' ELSE 'docs/' END || source || '.txt' AS file,
  coalesce(toxic = 1, false) AS deprecated, {_toks('text')} AS terms
  FROM documents LEFT JOIN labels USING (doc_id)"""

_AUTHORITY = """CASE WHEN deprecated THEN 0.4 ELSE 1.0 END * CASE WHEN list_has_any(string_split(lower(file), '/'),
  ['examples', 'example', 'test', 'tests', 'fixtures', 'testdata', 'templates']) THEN 0.5 ELSE 1.0 END
  * CASE WHEN kind IN ('moved', 'removed', 'import') THEN 0.6 ELSE 1.0 END"""


def _scores(nodes, query):
    """CTEs down to scored(node_key, module_dir, address, score)."""
    q = query.replace("'", "''")
    return f"""nodes AS ({nodes}),
 docs AS (SELECT *, {_FUSED_LEN} AS length, {_pairs('terms')} AS pairs,
   {_toks("address || ' ' || type")} AS ident FROM nodes),
 qt AS (SELECT {_toks(f"'{q}'")} AS terms),
 qall AS (SELECT DISTINCT unnest(terms) AS term, true AS plain FROM qt
   UNION SELECT term, false FROM (SELECT DISTINCT unnest({_pairs('terms')}) AS term FROM qt)
   WHERE term NOT IN (SELECT unnest(terms) FROM qt)),
 qset AS (SELECT list(term) AS ts FROM qall),
 freq AS (SELECT node_key, term, plain, length, len(list_filter(terms, lambda t: t = term))
   + 0.5 * len(list_filter(pairs, lambda t: t = term)) AS f FROM docs, qall),
 st AS (SELECT count(*)::DOUBLE AS n, greatest(1.0, sum(length) / count(*)) AS average FROM docs),
 dfs AS (SELECT term, sum(CASE WHEN f > 0 THEN 1 ELSE 0 END)::DOUBLE AS df FROM freq GROUP BY term),
 weighted AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM dfs, st WHERE n < 8 OR df <= n * 0.5),
 bm AS (SELECT node_key, sum(CASE WHEN f > 0 THEN idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / average))
     ELSE 0 END) AS bm25, sum(CASE WHEN plain THEN idf ELSE 0 END) AS asked,
   sum(CASE WHEN plain AND f > 0 THEN idf ELSE 0 END) AS answered
   FROM freq JOIN weighted USING (term), st GROUP BY node_key),
 body AS (SELECT node_key, CASE WHEN asked > 0 AND answered > 0
   THEN answered / asked * bm25 / (bm25 + 6.0) ELSE 0.0 END AS body FROM bm),
 scored AS (SELECT docs.*, (
   CASE WHEN lower(address) = lower('{q}') THEN 6.0 ELSE 0.0 END
   + CASE WHEN name <> '' AND lower(name) = lower('{q}') THEN 3.5 ELSE 0.0 END
   + CASE WHEN type <> '' AND lower(type) = lower('{q}') THEN 3.0 ELSE 0.0 END
   + 4.5 * CASE WHEN len(ident) = 0 THEN 0 ELSE len(list_filter(range(1, len(ident) + 1), lambda i:
       list_contains(ts, ident[i])
       OR (i < len(ident) AND list_contains(ts, ident[i] || ident[i + 1]))
       OR (i > 1 AND list_contains(ts, ident[i - 1] || ident[i])))) / len(ident)::DOUBLE END
   + coalesce(b.body, 0.0)) * ({_AUTHORITY}) AS score
   FROM docs LEFT JOIN body b USING (node_key), qset)"""


_PARTS = f"""SELECT p_partkey, p_brand || '|part.p' || p_partkey AS node_key, p_brand AS module_dir,
  'part.p' || p_partkey AS address, p_type AS type, p_name AS name, 'data' AS kind, p_brand AS file,
  false AS deprecated, {_toks("p_name || ' size ' || p_size || ' ' || p_type || ' ' || p_brand")} AS terms FROM part"""

_STAR_NODES = """SELECT 'geo|region.' || r_regionkey AS node_key, 'stack' AS kind, 'region' AS type, r_name AS name,
    'geo' AS module_dir, 'region.' || r_regionkey AS address, false AS expands FROM region
  UNION ALL SELECT 'geo|nation.' || n_nationkey, 'local', 'nation', n_name, 'geo', 'nation.' || n_nationkey, false FROM nation
  UNION ALL SELECT 'sales|customer.' || c_custkey, 'module', 'customer', c_name, 'sales', 'customer.' || c_custkey,
    c_acctbal < 0 FROM customer
  UNION ALL SELECT 'supply|supplier.' || s_suppkey, 'resource', 'supplier', s_name, 'supply', 'supplier.' || s_suppkey,
    s_acctbal > 0 FROM supplier
  UNION ALL SELECT 'sales|orders.' || o_orderkey, 'output', 'orders', o_orderpriority, 'sales', 'orders.' || o_orderkey,
    false FROM orders
  UNION ALL SELECT 'supply|part.' || p_partkey, 'variable', 'part', p_name, 'supply', 'part.' || p_partkey, false FROM part"""


def _seq(rank, *keys):
    return f"'{rank}'" + "".join(f" || '|' || lpad({k}::VARCHAR, 12, '0')" for k in keys)


_STAR_EDGES = f"""SELECT {_seq(1, 'n_nationkey')} AS seq, 'REFERENCES' AS kind, 'geo|nation.' || n_nationkey AS from_key,
    'geo|region.' || n_regionkey AS to_key, '' AS traversal, 'geo/nation' AS file, n_nationkey::INTEGER AS line FROM nation
  UNION ALL SELECT {_seq(2, 'c_custkey')}, 'REFERENCES', 'sales|customer.' || c_custkey, 'geo|nation.' || c_nationkey,
    c_mktsegment, 'sales/customer', c_custkey::INTEGER FROM customer
  UNION ALL SELECT {_seq(3, 's_suppkey')}, 'PROVIDES', 'supply|supplier.' || s_suppkey, 'geo|nation.' || s_nationkey,
    '', 'supply/supplier', s_suppkey::INTEGER FROM supplier
  UNION ALL SELECT {_seq(4, 'o_orderkey')}, 'CALLS', 'sales|orders.' || o_orderkey, 'sales|customer.' || o_custkey,
    o_orderstatus, 'sales/orders', 0 FROM orders
  UNION ALL SELECT {_seq(5, 'l_orderkey', 'l_linenumber', 'l_partkey')},
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'REFERENCES' WHEN l_returnflag = 'A' THEN 'INPUTS'
    ELSE 'DEPENDS_ON' END, 'sales|orders.' || l_orderkey, 'supply|part.' || l_partkey, l_linestatus,
    'sales/lineitem', l_linenumber FROM lineitem
  UNION ALL SELECT {_seq(6, 'l_orderkey', 'l_linenumber', 'l_suppkey')}, 'DEPENDS_ON', 'sales|orders.' || l_orderkey,
    'supply|supplier.' || l_suppkey, '', 'sales/lineitem', l_linenumber FROM lineitem"""

_LABEL_EDGES = """SELECT source || '|' || lang || '.d' || doc_id AS from_key,
  CASE WHEN labels.doc_id IS NOT NULL THEN 'labels|label.' || doc_id END AS to_key,
  CASE WHEN labels.doc_id IS NULL THEN 'label.' || doc_id ELSE '' END AS unresolved
  FROM documents LEFT JOIN labels USING (doc_id)"""


def _references(match):
    return f"""WITH nodes AS ({_STAR_NODES}), edges AS ({_STAR_EDGES}),
 d AS (SELECT node_key AS decl_key FROM nodes WHERE {match})
 SELECT d.decl_key, 'referenced_by' AS direction, e.kind, e.from_key AS peer_key, p.address AS peer_address,
   e.file, e.line, e.traversal FROM d JOIN edges e ON e.to_key = d.decl_key LEFT JOIN nodes p ON p.node_key = e.from_key
 UNION ALL
 SELECT d.decl_key, 'references', e.kind, e.to_key, p.address, e.file, e.line, e.traversal
   FROM d JOIN edges e ON e.from_key = d.decl_key LEFT JOIN nodes p ON p.node_key = e.to_key"""


def _walk(nodes, edges, origin, depth, at, peer):
    """Level by level: the least discovery path per new node."""
    sql = f"""WITH nodes AS ({nodes}), edges AS ({edges}),
 l0 AS (SELECT node_key, module_dir || chr(1) || address AS path, '' AS via_kind, '' AS via_from, '' AS via_to
   FROM nodes WHERE {origin})"""
    seen = "SELECT node_key FROM l0"
    for i in range(1, depth + 1):
        sql += f""",
 c{i} AS (SELECT e.{peer} AS node_key, l.path || chr(1) || e.seq AS path, e.kind, e.from_key, e.to_key,
   row_number() OVER (PARTITION BY e.{peer} ORDER BY l.path || chr(1) || e.seq, e.kind, e.from_key, e.to_key) AS r
   FROM l{i - 1} l JOIN edges e ON e.{at} = l.node_key
   WHERE e.to_key IS NOT NULL AND e.{peer} NOT IN ({seen})),
 l{i} AS (SELECT node_key, path, kind AS via_kind, from_key AS via_from, to_key AS via_to FROM c{i} WHERE r = 1)"""
        seen += f" UNION ALL SELECT node_key FROM l{i}"
    parts = [f"SELECT node_key, {i}::BIGINT AS depth, via_kind, via_from, via_to FROM l{i}" for i in range(1, depth + 1)]
    return sql + " " + " UNION ALL ".join(parts)


_LINE_INSTANCES = """SELECT 'r' || l_returnflag AS stack, 'supply|supplier.' || l_suppkey AS node_key,
  CASE WHEN l_discount > 0.05 THEN 'replace' ELSE 'update' END AS summary FROM lineitem
  WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)"""

_CALLS = """SELECT p_brand AS module_dir, p_name AS name, p_partkey,
  CASE WHEN p_size > 25 THEN './' || lower(p_type) ELSE p_type END AS source,
  CASE WHEN p_size % 7 = 0 THEN '(unpinned)' ELSE p_brand END AS version FROM part"""

_USAGE = """SELECT source, count(DISTINCT version)::BIGINT AS n_versions, count(*)::BIGINT AS n_sites,
  starts_with(source, './') AS local"""

_DIRS = """SELECT 'c' || c_custkey AS module_dir FROM customer UNION ALL SELECT 'o' || o_orderkey FROM orders
  UNION ALL SELECT 'p' || p_partkey FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier"""
_DIR_CALLS = """SELECT 'c' || o_custkey AS caller, 'o' || o_orderkey AS target FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem"""
_EXPLICIT = "SELECT 'p' || p_partkey FROM part WHERE p_size = 50"
_ROOTS = f"""SELECT module_dir FROM dirs WHERE module_dir NOT IN (SELECT target FROM calls)
  OR module_dir IN ({_EXPLICIT})"""

_CONFIG_NODES = """SELECT 'nations/n' || n_nationkey || '|provider.market.main' AS node_key, 'provider' AS kind,
    'market' AS type, 'market' AS name, 'nations/n' || n_nationkey AS stack, false AS shared,
    'nations/n' || n_nationkey || '/main.tf' AS file, 6::BIGINT AS line, 8::BIGINT AS end_line, '' AS doc,
    false AS has_count, false AS deprecated FROM nation
  UNION ALL SELECT 'nations/n' || n_nationkey || '|local.name', 'local', '', 'name', 'nations/n' || n_nationkey, false,
    'nations/n' || n_nationkey || '/main.tf', 11, 11, '', false, false FROM nation
  UNION ALL SELECT 'nations/n' || n_nationkey || '|module.market', 'module', '', 'market', 'nations/n' || n_nationkey, false,
    'nations/n' || n_nationkey || '/main.tf', 14, 18, '', false, false FROM nation
  UNION ALL SELECT 'nations/n' || n_nationkey || '|module.feed', 'module', '', 'feed', 'nations/n' || n_nationkey, false,
    'nations/n' || n_nationkey || '/main.tf', 20, 25, '', false, false FROM nation
  UNION ALL SELECT '|source.registry/feed' || chr(10) || '@1.2', 'module_source', '', 'feed' || chr(10), '', false,
    f, 20, 0, 'Remote module source; its internals are not indexed without an init.', false, false
    FROM (SELECT min('nations/n' || n_nationkey || '/main.tf') AS f FROM nation)
  UNION ALL SELECT 'nations/n' || n_nationkey || '|stack.nations/n' || n_nationkey, 'stack', '', 'n' || n_nationkey,
    'nations/n' || n_nationkey, false, 'nations/n' || n_nationkey, 1, 0,
    'Root module at nations/n' || n_nationkey || '.', false, false FROM nation
  UNION ALL SELECT '|source.registry/market/core@4.' || v || '.0', 'module_source', '', 'core', '', false,
    f, 14, 0, 'Remote module source; its internals are not indexed without an init.', false, false
    FROM (SELECT n_nationkey % 3 AS v, min('nations/n' || n_nationkey || '/main.tf') AS f FROM nation GROUP BY 1)
  UNION ALL SELECT 'nations/n' || c_nationkey || '|module.c' || c_custkey, 'module', '', 'c' || c_custkey,
    'nations/n' || c_nationkey, false, 'nations/n' || c_nationkey || '/c' || c_custkey || '.tf', 1, 7, '', false, false FROM customer
  UNION ALL SELECT 'nations/n' || c_nationkey || '|output.c' || c_custkey || '_id', 'output', '', 'c' || c_custkey || '_id',
    'nations/n' || c_nationkey, false, 'nations/n' || c_nationkey || '/c' || c_custkey || '.tf', 8, 10, '', false, false FROM customer
  UNION ALL SELECT '|source.../../customers/c' || c_custkey, 'module_source', '', 'c' || c_custkey, '', false,
    'nations/n' || c_nationkey || '/c' || c_custkey || '.tf', 1, 0, 'Local module source.', false, false FROM customer
  UNION ALL SELECT 'customers/c' || c_custkey || '|var.nation', 'variable', '', 'nation', 'nations/n' || c_nationkey, false,
    'customers/c' || c_custkey || '/main.tf', 1, 3, '', false, false FROM customer
  UNION ALL SELECT 'customers/c' || c_custkey || '|var.segment', 'variable', '', 'segment', 'nations/n' || c_nationkey, false,
    'customers/c' || c_custkey || '/main.tf', 4, 4, '', false, false FROM customer
  UNION ALL SELECT 'customers/c' || c_custkey || '|customer.this', 'resource', 'customer', 'this',
    'nations/n' || c_nationkey, false, 'customers/c' || c_custkey || '/main.tf', 7, 11,
    'customer.this in a comment is not a reference.', c_acctbal < 0, false FROM customer
  UNION ALL SELECT 'customers/c' || c_custkey || '|output.id', 'output', '', 'id', 'nations/n' || c_nationkey, false,
    'customers/c' || c_custkey || '/main.tf', 13, 15, '', false, false FROM customer
  UNION ALL SELECT 'customers/c' || o_custkey || '|orders.o' || o_orderkey, 'resource', 'orders', 'o' || o_orderkey,
    'nations/n' || c_nationkey, false, 'customers/c' || o_custkey || '/o' || o_orderkey || '.tf', 1, 13, '', false, false
    FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT 'customers/c' || o_custkey || '|moved.orders.old' || o_orderkey, 'moved', '', 'orders.old' || o_orderkey,
    'nations/n' || c_nationkey, false, 'customers/c' || o_custkey || '/o' || o_orderkey || '.tf', 14, 17, '', false, false
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'"""

_N, _C, _O = "'nations/n' || c_nationkey", "'customers/c' || c_custkey", "'customers/c' || o_custkey"
_CF = f"{_N} || '/c' || c_custkey || '.tf'"
_MF = f"{_C} || '/main.tf'"
_OF = f"{_O} || '/o' || o_orderkey || '.tf'"


def _edge(kind, source, target, traversal, file, line, table, unresolved="''"):
    return (
        f"SELECT '{kind}' AS kind, {source} AS from_key, {target} AS to_key, {traversal} AS traversal, "
        f"{unresolved} AS unresolved, {file} AS file, {line}::BIGINT AS line FROM {table}"
    )


_CONFIG_EDGES = " UNION ALL ".join([
    _edge("REFERENCES", "'nations/n' || n_nationkey || '|module.market'", "'nations/n' || n_nationkey || '|local.name'",
          "'local.name'", "'nations/n' || n_nationkey || '/main.tf'", 17, "nation"),
    _edge("CALLS", "'nations/n' || n_nationkey || '|module.market'",
          "'|source.registry/market/core@4.' || n_nationkey % 3 || '.0'", "'registry/market/core'",
          "'nations/n' || n_nationkey || '/main.tf'", 14, "nation"),
    _edge("CALLS", "'nations/n' || n_nationkey || '|module.feed'", "'|source.registry/feed' || chr(10) || '@1.2'",
          "'registry/feed' || chr(10)", "'nations/n' || n_nationkey || '/main.tf'", 20, "nation"),
    _edge("REFERENCES", f"{_N} || '|module.c' || c_custkey", f"{_N} || '|local.name'", "'local.name'", _CF, 3, "customer"),
    _edge("PROVIDES", f"{_N} || '|module.c' || c_custkey", f"{_N} || '|provider.market.main'", "'market.main'", _CF, 6, "customer"),
    _edge("CALLS", f"{_N} || '|module.c' || c_custkey", "'|source.../../customers/c' || c_custkey",
          "'../../customers/c' || c_custkey", _CF, 1, "customer"),
    _edge("INPUTS", f"{_N} || '|module.c' || c_custkey", f"{_C} || '|var.nation'",
          "'module.c' || c_custkey || ' → var.nation'", _CF, 3, "customer"),
    _edge("INPUTS", f"{_N} || '|module.c' || c_custkey", f"{_C} || '|var.segment'",
          "'module.c' || c_custkey || ' → var.segment'", _CF, 4, "customer"),
    _edge("REFERENCES", f"{_N} || '|output.c' || c_custkey || '_id'", f"{_N} || '|module.c' || c_custkey",
          "'module.c' || c_custkey || '.id'", _CF, 9, "customer"),
    _edge("REFERENCES", f"{_N} || '|output.c' || c_custkey || '_id'", f"{_C} || '|output.id'",
          "'module.c' || c_custkey || '.id'", _CF, 9, "customer"),
    _edge("REFERENCES", f"{_C} || '|customer.this'", f"{_C} || '|var.nation'", "'var.nation'", _MF, 9, "customer"),
    _edge("REFERENCES", f"{_C} || '|customer.this'", f"{_C} || '|var.nation'", "'var.nation'", _MF, 10, "customer"),
    _edge("REFERENCES", f"{_C} || '|output.id'", f"{_C} || '|customer.this'", "'customer.this.id'", _MF, 14, "customer"),
    _edge("REFERENCES", f"{_O} || '|orders.o' || o_orderkey", f"{_O} || '|customer.this'", "'customer.this.id'", _OF, 2, "orders"),
    _edge("REFERENCES", f"{_O} || '|orders.o' || o_orderkey", "NULL", "'var.lines'", _OF, 5, "orders", "'var.lines'"),
    _edge("REPLACE_TRIGGERED_BY", f"{_O} || '|orders.o' || o_orderkey", f"{_O} || '|customer.this'", "'customer.this'", _OF, 11, "orders"),
    _edge("MOVED_FROM", f"{_O} || '|moved.orders.old' || o_orderkey", f"{_O} || '|orders.o' || o_orderkey",
          "'orders.old' || o_orderkey || ' → orders.o' || o_orderkey", _OF, 14, "orders WHERE o_orderstatus = 'P'"),
])

_LINES = """SELECT 'orders/o' || l_orderkey AS stack, 'module.lines["p.' || l_partkey || '"]' AS m, 'p.' || l_partkey AS k,
  l_linenumber::VARCHAR AS i, l_returnflag, o_orderstatus FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE o_orderstatus IN ('O', 'F')"""


def all_sql() -> dict[str, str]:
    return {
        "tokenize_counts": f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms
            FROM (SELECT doc_id, {_toks('text')} AS t FROM documents)""",
        "stem_pairs": f"""SELECT word, {_stem('word')} AS stem FROM
            (SELECT DISTINCT unnest({_words('text')}) AS word FROM documents) WHERE strlen(word) >= 2""",
        "vectorized": f"""SELECT page_id, term, count(*)::DOUBLE AS weight FROM
            (SELECT page_id, unnest({_toks('html')}) AS term FROM pages) GROUP BY ALL""",
        "fused_postings": f"""WITH t AS (SELECT conv_id || '-' || turn AS id, {_toks('text')} AS terms FROM conversations)
            SELECT id, term, sum(w)::DOUBLE AS weight FROM (SELECT id, unnest(terms) AS term, 1.0 AS w FROM t
            UNION ALL SELECT id, unnest({_pairs('terms')}), 0.5 FROM t) GROUP BY id, term""",
        "term_df": f"""WITH t AS (SELECT doc_id, {_toks('text')} AS terms FROM documents)
            SELECT term, count(*)::BIGINT AS df FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(terms) AS term
            FROM t UNION ALL SELECT doc_id, unnest({_pairs('terms')}) FROM t)) GROUP BY term""",
        "corpus_stats": f"""WITH t AS (SELECT {_toks('text')} AS terms FROM documents)
            SELECT count(*)::BIGINT AS n_docs, round(sum(l), 1)::DOUBLE AS total_length,
            round(greatest(1, sum(l) / count(*)), 4)::DOUBLE AS avg_length FROM (SELECT ({_FUSED_LEN})::DOUBLE AS l FROM t)""",
        "idf_terms": f"""WITH t AS (SELECT doc_id, {_toks('text')} AS terms FROM documents),
            d AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(terms) AS term
            FROM t UNION ALL SELECT doc_id, unnest({_pairs('terms')}) FROM t)) GROUP BY term),
            n AS (SELECT count(*) AS n FROM documents)
            SELECT term, df::BIGINT AS df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 4)::DOUBLE AS idf,
            n < 8 OR df <= n * 0.5 AS informative FROM d, n""",
        "rarity_weights": f"""WITH t AS (SELECT doc_id, {_toks('text')} AS terms FROM documents),
            b AS (SELECT {_toks('text')} AS terms FROM benchmark),
            v AS (SELECT term, sum(w) AS w FROM (SELECT unnest(terms) AS term, 1.0 AS w FROM b
            UNION ALL SELECT unnest({_pairs('terms')}), 0.5 FROM b) GROUP BY term),
            d AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(terms) AS term
            FROM t UNION ALL SELECT doc_id, unnest({_pairs('terms')}) FROM t)) GROUP BY term),
            n AS (SELECT count(*) AS n FROM documents)
            SELECT term, round(w * ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)), 4)::DOUBLE AS weight
            FROM v LEFT JOIN d USING (term), n WHERE n < 8 OR coalesce(df, 0) <= n * 0.5""",
        "turn_similarity": f"""WITH t AS (SELECT conv_id, turn, {_toks('text')} AS terms FROM conversations),
            p AS (SELECT conv_id, turn, term, sum(w) AS w FROM (SELECT conv_id, turn, unnest(terms) AS term, 1.0::DOUBLE AS w
            FROM t UNION ALL SELECT conv_id, turn, unnest({_pairs('terms')}), 0.5 FROM t) GROUP BY ALL),
            s AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS norm FROM p GROUP BY ALL),
            dot AS (SELECT a.conv_id, a.turn, sum(a.w * b.w) AS dot FROM p a JOIN p b
            ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 AND a.term = b.term GROUP BY ALL)
            SELECT x.conv_id || '-' || x.turn AS id, round(coalesce(dot / (sa.norm * sb.norm), 0), 4)::DOUBLE AS similarity
            FROM t x JOIN t y ON x.conv_id = y.conv_id AND y.turn = x.turn - 1
            LEFT JOIN dot ON dot.conv_id = x.conv_id AND dot.turn = x.turn
            LEFT JOIN s sa ON sa.conv_id = x.conv_id AND sa.turn = x.turn
            LEFT JOIN s sb ON sb.conv_id = y.conv_id AND sb.turn = y.turn""",
        "explore_documents": f"""WITH {_scores(_DOCS, QUERY)},
            top AS (SELECT * FROM scored WHERE score >= 0.25
            ORDER BY round(score, 9) DESC, module_dir, address, node_key LIMIT 10),
            e AS ({_LABEL_EDGES})
            SELECT node_key, round(score, 4)::DOUBLE AS score, strlen(body)::BIGINT AS full_len,
            strlen(body) > greatest(600, 12000 // (SELECT count(*) FROM top)) AS truncated,
            (SELECT count(*) FROM e WHERE e.from_key = top.node_key)::BIGINT AS ref_count,
            (SELECT count(*) FROM e WHERE e.to_key = top.node_key)::BIGINT AS ref_by_count FROM top""",
        "explore_counters": f"""WITH {_scores(_DOCS, QUERY)},
            a AS (SELECT count(*) AS n, count(*) FILTER (WHERE score >= 0.25) AS above FROM scored)
            SELECT n::BIGINT AS considered, above::BIGINT AS above_threshold, least(above, 3)::BIGINT AS shown,
            greatest(least(above, 25) - 3, 0)::BIGINT AS dropped_for_budget FROM a""",
        "document_scores": f"WITH {_scores(_DOCS, QUERY)} SELECT node_key, round(score, 4)::DOUBLE AS score FROM scored",
        "explore_parts": f"""WITH {_scores(_PARTS, PART_QUERY)} SELECT node_key, name, type, round(score, 4)::DOUBLE AS score
            FROM (SELECT * FROM scored WHERE score >= 0.25
            ORDER BY round(score, 9) DESC, module_dir, address, node_key LIMIT 20)""",
        "part_scores": f"WITH {_scores(_PARTS, PART_QUERY)} SELECT node_key, round(score, 4)::DOUBLE AS score FROM scored",
        "authority": f"""WITH d AS ({_DOCS}) SELECT node_key, round({_AUTHORITY}, 4)::DOUBLE AS authority,
            starts_with(file, 'examples/') AS demoted FROM d""",
        "excerpt": """WITH k AS (SELECT doc_id, text, CASE WHEN strlen(text) > 600
            THEN list_max(list_filter(range(0, 601), lambda c: strlen(substr(text, 1, c)) <= 600)) END AS k FROM documents)
            SELECT doc_id, strlen(text)::BIGINT AS full_len, strlen(text) > 600 AS truncated,
            CASE WHEN k IS NULL THEN text ELSE substr(text, 1, k)
            || CASE WHEN strlen(substr(text, 1, k)) < 600 THEN chr(65533) ELSE '' END END AS text FROM k""",
        "node_counts": f"SELECT kind, count(*)::BIGINT AS n FROM ({_STAR_NODES}) GROUP BY kind",
        "edge_counts": f"SELECT kind, count(*)::BIGINT AS n FROM ({_STAR_EDGES}) GROUP BY kind",
        "graph_totals": f"""SELECT (SELECT count(*) FROM documents)::BIGINT AS n_nodes, count(*)::BIGINT AS n_edges,
            count(*) FILTER (WHERE to_key IS NULL)::BIGINT AS n_unresolved FROM ({_LABEL_EDGES})""",
        "unresolved_refs": f"SELECT from_key, unresolved FROM ({_LABEL_EDGES}) WHERE to_key IS NULL",
        "refs_by_address": _references("address = 'nation.3'"),
        "refs_by_name": _references("name = 'ASIA'"),
        "refs_by_type": _references("type = 'supplier'"),
        "declarations": f"SELECT node_key, kind, name FROM ({_STAR_NODES}) WHERE name = 'red widget'",
        "impact_dependents": _walk(_STAR_NODES, _STAR_EDGES, "address = 'region.0'", 3, "to_key", "from_key"),
        "impact_dependencies": _walk(_STAR_NODES, _STAR_EDGES, "type = 'orders'", 2, "from_key", "to_key"),
        "impact_summary": f"""WITH e AS ({_STAR_EDGES}), n AS ({_STAR_NODES}),
            s AS (SELECT 'geo|nation.3' AS node_key UNION SELECT from_key FROM e WHERE to_key = 'geo|nation.3'),
            i AS ({_LINE_INSTANCES})
            SELECT (SELECT count(*) FROM i JOIN s USING (node_key))::BIGINT AS instance_total,
            CASE WHEN (SELECT count(*) FROM i JOIN s USING (node_key)) > 0 THEN 'plan' ELSE '' END AS overlay_kind,
            (SELECT count(*) FROM s) > 1 AS truncated,
            (SELECT count(DISTINCT node_key) FROM i JOIN s USING (node_key) WHERE summary = 'replace')::BIGINT AS n_replacing,
            (SELECT count(DISTINCT address) FROM n JOIN s USING (node_key) WHERE expands)::BIGINT AS n_expanding""",
        "module_usage": f"{_USAGE} FROM ({_CALLS}) GROUP BY source",
        "module_versions": f"""SELECT source, version, count(*)::BIGINT AS n_sites,
            (count(*) OVER (PARTITION BY source))::BIGINT AS n_versions, starts_with(source, './') AS local
            FROM ({_CALLS}) GROUP BY source, version""",
        "module_filter": f"""{_USAGE} FROM ({_CALLS}) WHERE contains(lower(source), 'red') OR contains(lower(name), 'red')
            GROUP BY source""",
        "module_first_sites": f"""SELECT * FROM (SELECT source, version AS pinned,
            module_dir || '|module.p' || p_partkey AS node_key, row_number() OVER (PARTITION BY source, version
            ORDER BY module_dir || '|module.p' || p_partkey)::BIGINT AS rank FROM ({_CALLS})) WHERE rank <= 4""",
        "star_orphans": f"""WITH e AS ({_STAR_EDGES}), u AS (SELECT to_key,
            count(*) FILTER (WHERE kind = 'REFERENCES') AS reads, count(*) FILTER (WHERE kind = 'INPUTS') AS wired
            FROM e GROUP BY to_key)
            SELECT node_key, CASE WHEN kind = 'variable' AND wired > 0
            THEN 'declared and wired up by callers, but never read inside this module'
            WHEN kind = 'variable' THEN 'declared but never referenced' WHEN kind = 'local' THEN 'computed but never referenced'
            ELSE 'exported by a child module but consumed by no caller' END AS reason
            FROM ({_STAR_NODES}) n LEFT JOIN u ON u.to_key = n.node_key
            WHERE kind IN ('variable', 'local', 'output') AND coalesce(reads, 0) = 0
            AND NOT (kind = 'output' AND module_dir = 'geo')""",
        "instances_of": f"""SELECT node_key, stack, count(*)::BIGINT AS n_instances,
            string_agg(DISTINCT summary, ',' ORDER BY summary) AS planned FROM ({_LINE_INSTANCES}) GROUP BY node_key, stack""",
        "instance_actions": """WITH a AS (SELECT l_orderkey, list_sort(list(CASE l_returnflag WHEN 'R' THEN 'delete'
            WHEN 'A' THEN 'create' ELSE 'no-op' END)) AS a FROM lineitem GROUP BY l_orderkey)
            SELECT l_orderkey, list_contains(a, 'delete') AND list_contains(a, 'create') AS replaces,
            len(list_filter(a, lambda x: x NOT IN ('no-op', 'read'))) > 0 AS changes,
            CASE WHEN list_contains(a, 'delete') AND list_contains(a, 'create') THEN 'replace'
            ELSE array_to_string(a, '+') END AS summary FROM a""",
        "roots": f"WITH dirs AS ({_DIRS}), calls AS ({_DIR_CALLS}) {_ROOTS}",
        "owning_stacks": f"""WITH dirs AS ({_DIRS}), calls AS ({_DIR_CALLS}), r AS ({_ROOTS}),
            c AS (SELECT target, count(DISTINCT caller) AS n, min(caller) AS one FROM calls GROUP BY target)
            SELECT module_dir, CASE WHEN module_dir IN (SELECT * FROM r) THEN module_dir WHEN n = 1 THEN one ELSE '' END AS stack,
            module_dir NOT IN (SELECT * FROM r) AND coalesce(n, 0) > 1 AS shared FROM dirs LEFT JOIN c ON target = module_dir""",
        "stack_paths": f"""WITH RECURSIVE dirs AS ({_DIRS}), calls AS ({_DIR_CALLS}), p AS (
            SELECT module_dir, module_dir AS stack, '' AS module_address FROM ({_ROOTS})
            UNION SELECT target, stack, CASE WHEN module_address = '' THEN '' ELSE module_address || '.' END
            || 'module.' || target FROM p JOIN calls ON caller = module_dir) SELECT * FROM p""",
        "local_targets": """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'c/e' WHEN 1 THEN 'a/b' || page_id || '/x' || page_id
            END AS target FROM pages""",
        "config_nodes": _CONFIG_NODES,
        "config_edges": _CONFIG_EDGES,
        "config_roots": "SELECT 'nations/n' || n_nationkey AS module_dir FROM nation",
        "config_stack_paths": """SELECT 'nations/n' || n_nationkey AS module_dir, 'nations/n' || n_nationkey AS stack,
            '' AS module_address FROM nation UNION ALL SELECT 'customers/c' || c_custkey, 'nations/n' || c_nationkey,
            'module.c' || c_custkey FROM customer""",
        "config_instances": """SELECT 'nations/n' || c_nationkey || '|module.c' || c_custkey AS node_key,
            'nations/n' || c_nationkey AS stack, 'module.c' || c_custkey AS address, '' AS index_key FROM customer
            UNION ALL SELECT 'customers/c' || c_custkey || '|customer.this', 'nations/n' || c_nationkey,
            'module.c' || c_custkey || '.customer.this' || CASE WHEN i = '' THEN '' ELSE '[' || i || ']' END, i
            FROM customer, unnest(CASE WHEN c_acctbal < 0 THEN ['0', '1'] ELSE [''] END) AS t(i)
            UNION ALL SELECT 'customers/c' || c_custkey || '|orders.o' || o_orderkey, 'nations/n' || c_nationkey,
            'module.c' || c_custkey || '.orders.o' || o_orderkey, '' FROM orders JOIN customer ON c_custkey = o_custkey""",
        "config_paths_into": """SELECT 'customers/c' || c_custkey AS module_dir, 'nations/n' || c_nationkey AS stack,
            'module.c' || c_custkey AS module_address FROM customer WHERE c_acctbal < 0""",
        "config_orphans": """SELECT 'customers/c' || c_custkey || '|var.segment' AS node_key,
            'declared and wired up by callers, but never read inside this module' AS reason FROM customer""",
        "config_modules": """SELECT 'registry/market/core' AS source, count(DISTINCT n_nationkey % 3)::BIGINT AS n_versions,
            count(*)::BIGINT AS n_sites, false AS local FROM nation
            UNION ALL SELECT 'registry/feed' || chr(10), 1, count(*), false FROM nation
            UNION ALL SELECT '../../customers/c' || c_custkey, 1, 1, true FROM customer""",
        "config_impact": f"""WITH nodes AS ({_CONFIG_NODES}), edges AS ({_CONFIG_EDGES}),
            o AS (SELECT node_key FROM nodes WHERE name = 'nation'),
            l1 AS (SELECT e.from_key AS node_key, min_by(e.kind, e.from_key || e.kind || e.line) AS k FROM edges e
              JOIN o ON o.node_key = e.to_key WHERE e.from_key NOT IN (SELECT node_key FROM o) GROUP BY 1),
            x1 AS (SELECT e.* FROM edges e JOIN o ON o.node_key = e.to_key),
            x2 AS (SELECT e.* FROM edges e JOIN l1 ON l1.node_key = e.to_key
              WHERE e.from_key NOT IN (SELECT node_key FROM l1) AND e.from_key NOT IN (SELECT node_key FROM o))
            SELECT from_key AS node_key, 1::BIGINT AS depth, min(kind) AS via_kind, from_key AS via_from, min(to_key) AS via_to
            FROM x1 GROUP BY from_key UNION ALL
            SELECT from_key, 2, min(kind), from_key, min(to_key) FROM x2 GROUP BY from_key""",
        "overlay_instances": f"""WITH l AS ({_LINES})
            SELECT stack, 'module.lines' AS module_address, 'item.line' AS config_address, m || '.item.line[' || i || ']' AS address,
            i AS index_key, CASE WHEN o_orderstatus = 'F' THEN '' WHEN l_returnflag = 'R' THEN 'delete+create'
            WHEN l_returnflag = 'A' THEN 'update' ELSE 'no-op' END AS actions FROM l
            UNION ALL SELECT DISTINCT stack, '', 'module.lines', m, k, '' FROM l
            UNION ALL SELECT DISTINCT stack, '', 'orders.this', 'orders.this', '', '' FROM l WHERE o_orderstatus = 'F'""",
        "overlay_sources": """SELECT DISTINCT 'orders/o' || l_orderkey AS stack, 'orders/o' || l_orderkey || '/show.json' AS source,
            CASE o_orderstatus WHEN 'O' THEN 'plan' ELSE 'state' END AS kind,
            CASE o_orderstatus WHEN 'O' THEN '1.6' ELSE '1.5' END AS terraform_version
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('O', 'F')""",
        "overlay_failures": """SELECT DISTINCT 'orders/o' || l_orderkey || '/show.json' AS source, 'orders/o' || l_orderkey
            || '/show.json: has neither resource_changes nor values; it is not a plan or state document' AS reason
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'""",
        "overlay_pick": """SELECT stack, path FROM (SELECT source AS stack, source || '/' || lpad(doc_id::VARCHAR, 9, '0') AS path,
            row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 2 ELSE 4 END, doc_id) AS r
            FROM documents WHERE lang IN ('de', 'en', 'fr')) WHERE r = 1""",
        "uncovered_roots": """SELECT 'orders/o' || o_orderkey AS module_dir FROM orders
            WHERE o_orderstatus = 'P' OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
        "json_index": "SELECT event_id, json_extract_string(props, '$.k') AS index_key FROM events",
        "module_address_split": """SELECT 'module.o' || l_orderkey || '["' || l_returnflag || '.' || l_linestatus || '"].module.p'
            || l_partkey || '[' || l_linenumber || ']' AS address, 'module.o' || l_orderkey || '.module.p' || l_partkey AS normalized,
            l_returnflag || '.' || l_linestatus || '/' || l_linenumber AS keys FROM lineitem""",
        "budget_prefix": """SELECT source, doc_id, rank::BIGINT AS rank, spent_before::BIGINT AS spent_before FROM (
            SELECT source, doc_id, row_number() OVER w AS rank,
            coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS spent_before FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
            WHERE rank <= 40 AND spent_before < 4000""",
        "budget_greedy": """WITH RECURSIVE d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
            f AS (SELECT 0::BIGINT AS r, 0::BIGINT AS doc_id, 0::BIGINT AS n_chars, 0::BIGINT AS spent, false AS kept
            UNION ALL SELECT d.r, d.doc_id, d.n_chars, CASE WHEN f.spent + d.n_chars <= 20000 THEN f.spent + d.n_chars
            ELSE f.spent END, f.spent + d.n_chars <= 20000 FROM f JOIN d ON d.r = f.r + 1)
            SELECT doc_id, n_chars, ((SELECT count(*) FROM documents) - (SELECT count(*) FROM f WHERE kept))::BIGINT AS dropped
            FROM f WHERE kept""",
        "fingerprint": """SELECT max(ts)::VARCHAR AS newest, count(*)::BIGINT AS n, sum(length(props))::BIGINT AS total FROM events""",
        "counts_sorted": "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type",
    }
