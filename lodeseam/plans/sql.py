"""DuckDB SQL for the queries over the driver tables: written from the definitions, not generated from the plans."""

from __future__ import annotations

from lodeseam.schema import LANGUAGES


def tokens(text: str) -> str:
    """The token list of an SQL expression."""
    parts = "list_filter(string_split(r, '_'), lambda s: s <> '')"
    cased = r"regexp_extract_all(s, '(^[^\p{Lu}]+|\p{Lu}[^\p{Lu}]*)')"
    return rf"""coalesce(flatten(list_transform(list_filter(list_transform(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+'), lambda r: trim(r, '_')), lambda r: r <> ''),
      lambda r: [lower(r)]
        || list_filter(list_transform(range(1, len({parts}) + 1), lambda i: CASE WHEN ({parts})[i] <> CASE WHEN i = 1 THEN lower(r) ELSE lower(({parts})[i - 1]) END THEN lower(({parts})[i]) END), lambda x: x IS NOT NULL)
        || flatten(list_transform(string_split(r, '_'), lambda s: CASE WHEN len({cased}) > 1 THEN list_transform({cased}, lambda z: lower(z)) ELSE CAST([] AS VARCHAR[]) END)))), CAST([] AS VARCHAR[]))"""


CHUNKS = r"""chunks AS (
  SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source || '/' || doc_id || '.txt' AS file_path, lang AS language, 'doc_' || doc_id AS symbol_name, 'function' AS symbol_type,
         1 AS start_line, text AS code, lang AS version_id, 'lang ' || lang AS version_label FROM documents)"""
SEARCHABLE = "'FILE: ' || file_path || chr(10) || 'LANGUAGE: ' || language || chr(10) || 'TYPE: ' || symbol_type || chr(10) || 'SYMBOL: ' || symbol_name || chr(10) || 'CODE:' || chr(10) || code"
METADATA = "file_path || ' ' || language || ' ' || symbol_name || ' ' || symbol_type"
TOKENS = f"{CHUNKS}, tokenized AS (SELECT chunk_id, file_path, start_line, version_id, version_label, {tokens(SEARCHABLE)} AS tokens FROM chunks)"
POSTINGS = f"""{TOKENS},
words AS (SELECT chunk_id, unnest(tokens) AS term FROM tokenized),
postings AS (SELECT chunk_id, term, count(*) AS tf FROM words GROUP BY ALL),
term_stats AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
doc_stats AS (SELECT chunk_id, len(tokens) AS dl, file_path, start_line FROM tokenized),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM doc_stats)"""
BM25 = f"""{POSTINGS},
asked AS (SELECT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark),
terms AS (SELECT query_id, term, count(*) AS qtf FROM asked GROUP BY ALL),
lexical AS (
  SELECT query_id, chunk_id, file_path, start_line,
         sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM terms JOIN term_stats USING (term) JOIN postings USING (term) JOIN doc_stats USING (chunk_id), corpus GROUP BY ALL),
lexical_top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, lower(file_path), start_line, chunk_id) AS rank
  FROM lexical QUALIFY rank <= 50)"""
UNIT = """unit AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings)"""
#: Benchmark items ask with the vector of the same number.
SEMANTIC = f"""{UNIT},
semantic AS (
  SELECT item_id AS query_id, CAST(u.vec_id AS VARCHAR) AS chunk_id, round(list_inner_product(q.v, u.v), 9) AS score
  FROM benchmark JOIN unit q ON q.vec_id = item_id, unit u WHERE u.vec_id IN (SELECT doc_id FROM documents)),
semantic_top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM semantic QUALIFY rank <= 50)"""
MINMAX = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
FUSED = f"""{BM25}, {SEMANTIC},
l AS (SELECT *, {MINMAX} AS nl FROM lexical_top WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT *, {MINMAX} AS ns FROM semantic_top WINDOW w AS (PARTITION BY query_id)),
fused AS (
  SELECT query_id, chunk_id, c.file_path, c.start_line, l.score AS lexical_score, s.score AS semantic_score, l.rank AS lexical_rank, s.rank AS semantic_rank,
         coalesce(nl, 0) AS nl, coalesce(ns, 0) AS ns, (0.5 * coalesce(nl, 0) + 0.5 * coalesce(ns, 0)) / 1.0 AS score
  FROM (SELECT * FROM l) l FULL JOIN s USING (query_id, chunk_id) JOIN chunks c USING (chunk_id))"""
LANGUAGE = "CASE " + " ".join(f"WHEN regexp_matches(lower(query), '(^|[^a-z0-9]){n}([^a-z0-9]|$)') THEN '{v}'" for n, v in (("javascript", "JavaScript"), ("typescript", "TypeScript"), ("python", "Python"), ("java", "Java"), (r"c\+\+", "C++"))) + " END"


def _roles() -> str:
    from lodeseam.operators.rerank import ROLES

    array = lambda terms: "[" + ", ".join(f"'{w}'" for w in terms) + "]"
    return "list_distinct(" + " || ".join(f"CASE WHEN list_has_any(q, {array(a)}) THEN {array(b)} ELSE CAST([] AS VARCHAR[]) END" for a, b in ROLES) + ")"


FEATURES = f"""{FUSED},
asking AS (SELECT item_id AS query_id, text AS query, list_distinct({tokens('text')}) AS q FROM benchmark),
expecting AS (SELECT *, {_roles()} AS expected, {LANGUAGE} AS asked_language FROM asking),
rated AS (
  SELECT f.query_id, f.chunk_id, f.file_path, f.start_line, ns AS semantic, nl AS lexical,
         CASE WHEN regexp_matches(lower(query), '(^|[^a-z0-9_])' || symbol_name || '([^a-z0-9_]|$)') THEN 1.0 ELSE 0.0 END AS exact_symbol,
         len(list_intersect(q, {tokens('f.file_path')})) / len(q) AS filename,
         CASE WHEN asked_language IS NULL OR lower(asked_language) = lower(language) THEN 1.0 ELSE 0.0 END AS language,
         CASE WHEN len(expected) = 0 THEN 0.0 ELSE len(list_intersect(expected, {tokens(METADATA.replace('file_path', 'c.file_path'))})) / len(expected) END AS intent,
         len(list_intersect(q, {tokens(METADATA.replace('file_path', 'c.file_path'))})) / len(q) AS metadata
  FROM fused f JOIN chunks c USING (chunk_id) JOIN expecting USING (query_id))"""
RERANKED = f"""{FEATURES},
final AS (SELECT *, 0.25 * semantic + 0.25 * lexical + 0.10 * exact_symbol + 0.075 * filename + 0.025 * language + 0.10 * intent + 0.15 * metadata AS score FROM rated)"""
#: Parts as symbols: the first word of the name is the class, brand and size are the file.
PARTS = r"""chunks AS (
  SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, replace(p_brand, '#', '_') || '/' || p_size || '.py' AS file_path, replace(p_name, ' ', '.') AS symbol_name, split_part(p_name, ' ', 1) AS parent_symbol,
         ['x.' || split_part(p_name, ' ', 2), 'x.' || split_part(p_name, ' ', 1)] AS calls FROM part),
local AS (SELECT file_path, regexp_extract(symbol_name, '[^.]*$') AS key, CASE WHEN min(chunk_id) = max(chunk_id) THEN min(chunk_id) END AS hit FROM chunks GROUP BY ALL),
keys AS (SELECT DISTINCT chunk_id, unnest([symbol_name, regexp_extract(symbol_name, '[^.]*$')]) AS key FROM chunks),
anywhere AS (SELECT key, CASE WHEN min(chunk_id) = max(chunk_id) THEN min(chunk_id) END AS hit FROM keys GROUP BY key)"""


def resolved(wanted: str, local: str = "local", anywhere: str = "anywhere") -> str:
    """Resolution of ``wanted`` (chunk_id, file_path, name)."""
    return rf"""SELECT w.*, coalesce(l.hit, e.hit, f.hit) AS target FROM {wanted} w
  LEFT JOIN {local} l ON l.file_path = w.file_path AND l.key = regexp_extract(name, '[^.]*$')
  LEFT JOIN {anywhere} e ON e.key = name LEFT JOIN {anywhere} f ON f.key = regexp_extract(name, '[^.]*$')"""


GRAPH = f"""{PARTS},
called AS (SELECT DISTINCT chunk_id, file_path, unnest(calls) AS name FROM chunks),
inner_ AS (SELECT chunk_id, file_path, parent_symbol AS name FROM chunks),
calls_ AS (SELECT DISTINCT 'symbol::' || chunk_id AS source, 'symbol::' || target AS target FROM ({resolved('called')}) WHERE target IS NOT NULL),
contains_ AS (SELECT CASE WHEN target IS NOT NULL AND target <> chunk_id THEN 'symbol::' || target ELSE 'file::' || file_path END AS source, 'symbol::' || chunk_id AS target FROM ({resolved('inner_')})),
relations AS (SELECT source, target, 0 AS place, 'CONTAINS' AS relation FROM contains_ UNION SELECT source, target, 1, 'CALLS' FROM calls_),
edges AS (SELECT source, target, string_agg(relation, ',' ORDER BY place) AS relation FROM relations GROUP BY ALL)"""
#: Parts as modules with names, and, every other size, as classes with bases.
MODULES = rf"""{PARTS},
modules AS (SELECT CAST(p_partkey AS VARCHAR) AS chunk_id, replace(p_brand, '#', '_') AS brand, CAST(regexp_extract(p_brand, '[0-9]+$') AS INTEGER) AS number, p_size % 50 AS size, p_size % 2 = 0 AS is_class,
  split_part(p_name, ' ', 1) AS first_word, split_part(p_name, ' ', 2) AS second_word,
  lead(split_part(p_name, ' ', 2)) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS after FROM part),
named AS (SELECT DISTINCT chunk_id, file_path, unnest([after, second_word || '.' || first_word]) AS name FROM chunks JOIN modules USING (chunk_id)),
based AS (SELECT DISTINCT chunk_id, file_path, unnest(['m.' || first_word, second_word]) AS name FROM chunks JOIN modules USING (chunk_id) WHERE is_class),
classes AS (SELECT chunks.* FROM chunks JOIN modules USING (chunk_id) WHERE is_class),
class_local AS (SELECT file_path, regexp_extract(symbol_name, '[^.]*$') AS key, CASE WHEN min(chunk_id) = max(chunk_id) THEN min(chunk_id) END AS hit FROM classes GROUP BY ALL),
class_keys AS (SELECT DISTINCT chunk_id, unnest([symbol_name, regexp_extract(symbol_name, '[^.]*$')]) AS key FROM classes),
class_anywhere AS (SELECT key, CASE WHEN min(chunk_id) = max(chunk_id) THEN min(chunk_id) END AS hit FROM class_keys GROUP BY key),
stems AS (SELECT DISTINCT file_path, unnest([brand || '/' || (size + 1), 'Brand_' || (number + 1) || '/' || (size + 1), brand || '/' || (size + 2)]) AS stem FROM chunks JOIN modules USING (chunk_id))"""
#: Walks without a node twice, up to three hops, from the dearest part of each brand.
WALKS = f"""{GRAPH},
labels AS (SELECT 'symbol::' || chunk_id AS node, symbol_name AS label FROM chunks UNION ALL SELECT DISTINCT 'file::' || file_path, file_path FROM chunks),
moves AS (
  SELECT source AS at_node, target AS to_node, struct_pack(relation := relation, source := source, target := target) AS step, relation || ' -> ' AS said FROM relations
  UNION ALL SELECT target, source, struct_pack(relation := relation, source := source, target := target), CASE relation WHEN 'CALLS' THEN 'CALLED_BY' ELSE 'CONTAINED_BY' END || ' <- ' FROM relations WHERE source <> target),
spoken AS (SELECT moves.*, said || label AS says FROM moves JOIN labels ON node = to_node),
seeds AS (SELECT p_brand AS query_id, 'symbol::' || arg_max(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) AS seed FROM part GROUP BY p_brand),
walks AS (
  SELECT query_id, seed, seed AS node_id, 0 AS hops, CAST([] AS STRUCT(relation VARCHAR, source VARCHAR, target VARCHAR)[]) AS path, [seed] AS seen, CAST([] AS VARCHAR[]) AS said FROM seeds
  UNION ALL SELECT query_id, seed, to_node, hops + 1, list_append(path, step), list_append(seen, to_node), list_append(walks.said, says)
  FROM walks JOIN spoken ON at_node = node_id WHERE hops < 3 AND NOT list_contains(seen, to_node)),
met AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY hops, path) AS nth FROM walks WHERE hops > 0 AND node_id LIKE 'symbol::%' QUALIFY nth = 1),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hops, path) AS place FROM met QUALIFY place <= 100)"""


def _multi_pass() -> str:
    """All passes: documents call the next one of their source, vectors count tokens by the first hex digit of their MD5."""
    calling = "CASE WHEN calls IS NULL THEN '' ELSE chr(10) || 'CALLS: ' || calls END"
    said = SEARCHABLE.replace("|| chr(10) || 'CODE:'", f"|| {calling} || chr(10) || 'CODE:'")
    metadata = METADATA.replace("file_path", "c.file_path") + " || ' ' || coalesce(calls, '')"
    base = POSTINGS.replace(tokens(SEARCHABLE), tokens(said)).replace(" FROM documents)", ", lead('doc_' || doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS calls FROM documents)", 1)
    digits = "['" + "', '".join("0123456789abcdef") + "']"

    def vector(toks: str) -> str:
        counts = f"list_transform({digits}, lambda d: CAST(len(list_filter({toks}, lambda t: md5(t)[1] = d)) AS DOUBLE))"
        return f"(SELECT list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) FROM (SELECT {counts} AS v))"

    def channels(n: int, asked: str, k: int) -> str:
        return f"""terms{n} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM {asked}) GROUP BY ALL),
scored{n} AS (
  SELECT query_id, chunk_id, file_path, start_line, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM terms{n} JOIN term_stats USING (term) JOIN postings USING (term) JOIN doc_stats USING (chunk_id), corpus GROUP BY ALL),
lex{n} AS (SELECT query_id, chunk_id, score FROM scored{n} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, lower(file_path), start_line, chunk_id) <= {k}),
spoken{n} AS (SELECT query_id, {tokens('query')} AS tokens FROM {asked}),
asks{n} AS (SELECT query_id, {vector('tokens')} AS v FROM spoken{n}),
near{n} AS (SELECT query_id, chunk_id, round(list_inner_product(a.v, u.v), 9) AS score FROM asks{n} a, units u),
sem{n} AS (SELECT query_id, chunk_id, score FROM near{n} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {k})"""

    def fused(name: str, lex: str, sem: str) -> str:
        return f"""{name} AS (
  SELECT query_id, chunk_id, coalesce(nl, 0) AS nl, coalesce(ns, 0) AS ns
  FROM (SELECT query_id, chunk_id, {MINMAX} AS nl FROM {lex} WINDOW w AS (PARTITION BY query_id)) FULL JOIN (SELECT query_id, chunk_id, {MINMAX} AS ns FROM {sem} WINDOW w AS (PARTITION BY query_id)) USING (query_id, chunk_id))"""

    def reranked(name: str, candidates: str, k: int) -> str:
        return f"""{name}_rated AS (
  SELECT f.query_id, f.chunk_id, c.file_path, c.start_line,
    (0.25 * ns + 0.25 * nl + 0.10 * CASE WHEN regexp_matches(lower(query), '(^|[^a-z0-9_])' || symbol_name || '([^a-z0-9_]|$)') THEN 1.0 ELSE 0.0 END
     + 0.075 * len(list_intersect(q, {tokens('c.file_path')})) / len(q) + 0.025 * CASE WHEN asked_language IS NULL OR lower(asked_language) = lower(language) THEN 1.0 ELSE 0.0 END
     + 0.10 * CASE WHEN len(expected) = 0 THEN 0.0 ELSE len(list_intersect(expected, m)) / len(expected) END + 0.15 * len(list_intersect(q, m)) / len(q)
     + 0.05 * len(list_intersect(q, {tokens("coalesce(calls, '')")})) / len(q) + 0.10 * graph) / 1.1 AS score
  FROM {candidates} f JOIN described c USING (chunk_id) JOIN expecting USING (query_id)),
{name} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, lower(file_path), start_line, chunk_id) AS rank FROM {name}_rated QUALIFY rank <= {k})"""

    return f"""{base},
asked AS (SELECT item_id AS query_id, text AS query FROM benchmark),
asking AS (SELECT *, list_distinct({tokens('query')}) AS q FROM asked),
expecting AS (SELECT *, {_roles()} AS expected, {LANGUAGE} AS asked_language FROM asking),
described AS (SELECT c.*, list_distinct({tokens(metadata)}) AS m FROM chunks c),
units AS (SELECT chunk_id, {vector('tokens')} AS v FROM tokenized),
{channels(1, 'asked', 50)},
{fused('pass_one', 'lex1', 'sem1')},
first_pass AS (SELECT *, 0.0 AS graph FROM pass_one),
{reranked('seeds', 'first_pass', 3)},
calling AS (SELECT c.chunk_id AS a, t.chunk_id AS b FROM chunks c JOIN chunks t ON t.symbol_name = c.calls),
steps AS (SELECT a, b FROM calling UNION ALL SELECT b, a FROM calling),
walked AS (
  SELECT query_id, s.chunk_id AS seed, b AS chunk_id, 1 AS hops FROM seeds s JOIN steps ON a = s.chunk_id
  UNION ALL SELECT query_id, s.chunk_id, t.b, 2 FROM seeds s JOIN steps o ON o.a = s.chunk_id JOIN steps t ON t.a = o.b WHERE t.b <> s.chunk_id),
expanded AS (SELECT query_id, chunk_id, min(hops) AS hops FROM walked GROUP BY ALL),
told AS (
  SELECT query_id, left(trim(query) || chr(10) || string_agg(symbol_name || ' ' || file_path || CASE WHEN calls IS NULL THEN '' ELSE ' ' || calls END || CASE WHEN code = '' THEN '' ELSE ' ' || left(code, 1000) END, chr(10) ORDER BY hops, chunk_id), 4000) AS query
  FROM expanded JOIN chunks USING (chunk_id) JOIN asked USING (query_id) GROUP BY query_id, asked.query),
{channels(2, 'told', 25)},
lex AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT * FROM lex1 UNION ALL SELECT * FROM lex2) GROUP BY ALL),
sem AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT * FROM sem1 UNION ALL SELECT * FROM sem2) GROUP BY ALL),
{fused('everything', 'lex', 'sem')},
last_pass AS (
  SELECT query_id, chunk_id, coalesce(nl, 0) AS nl, coalesce(ns, 0) AS ns, coalesce(1.0 / hops, 0.0) AS graph FROM everything FULL JOIN expanded USING (query_id, chunk_id)),
{reranked('results', 'last_pass', 10)},
report AS (
  SELECT query_id, (SELECT count(*) FROM pass_one x WHERE x.query_id = a.query_id) AS pass1, (SELECT count(*) FROM seeds x WHERE x.query_id = a.query_id) AS seeds,
         (SELECT count(*) FROM expanded x WHERE x.query_id = a.query_id) AS expansions, (SELECT count(*) FROM last_pass x WHERE x.query_id = a.query_id) AS pass5,
         (SELECT count(*) FROM last_pass x ANTI JOIN pass_one y USING (query_id, chunk_id) WHERE x.query_id = a.query_id) AS added FROM asked a)"""


MULTI_PASS = _multi_pass()
#: What is asked and what is answered in a conversation, as chunks of two versions.
MESSAGES = rf"""said AS (
  SELECT conv_id // 40 AS pair_id, conv_id || ':' || lpad(CAST(turn AS VARCHAR), 5, '0') AS chunk_id, role, turn // 2 AS symbol, ['aa', 'bb', 'cc'][turn % 3 + 1] AS path,
         ['function', 'method', 'class'][conv_id % 3 + 1] AS kind, conv_id // 3 % 3 AS arity, conv_id % 4 AS calls,
         'def f(' || ['', 'a', 'a, b'][conv_id // 3 % 3 + 1] || '):' || chr(10) || '    pass' || chr(10) || '# ' || regexp_replace(coalesce(text, ''), '[\x00\r\n\f]', ' ', 'g') AS code
  FROM conversations WHERE role IN ('user', 'assistant')),
searchable AS (
  SELECT *, 'FILE: ' || path || chr(10) || 'LANGUAGE: text' || chr(10) || 'TYPE: ' || kind || chr(10) || 'SYMBOL: turn_' || symbol || chr(10)
    || CASE WHEN calls > 0 THEN 'CALLS: ' || array_to_string(list_transform(range(calls), lambda i: 'f'), ', ') || chr(10) ELSE '' END || 'CODE:' || chr(10) || code AS full_text FROM said),
digits AS (SELECT *, list_distinct({tokens('full_text')}) AS tokens, list_transform({tokens('code')}, lambda t: left(md5(t), 1)) AS digits FROM searchable),
messages AS (SELECT *, list_transform(string_split('0123456789abcdef', ''), lambda h: CAST(len(list_filter(digits, lambda x: x = h)) AS DOUBLE)) AS v FROM digits),
met AS (
  SELECT s.pair_id, s.chunk_id AS s_chunk_id, t.chunk_id AS t_chunk_id, CASE WHEN s.symbol = t.symbol THEN 1.0 ELSE 0.2 END AS symbol, CASE WHEN s.path = t.path THEN 1.0 ELSE 0.0 END AS file_path,
         0.45 * CASE WHEN s.kind = t.kind THEN 1.0 WHEN 'class' IN (s.kind, t.kind) THEN 0.0 ELSE 0.5 END + CAST(0.30 AS DOUBLE) * (3 + least(s.arity, t.arity)) / (3 + greatest(s.arity, t.arity))
           + CAST(0.15 AS DOUBLE) * (1 - abs(s.arity - t.arity) / greatest(s.arity, t.arity, 1)) + CAST(0.10 AS DOUBLE) * (1 - abs(s.calls - t.calls) / greatest(s.calls, t.calls, 1)) AS structure,
         CASE WHEN s.path = 'aa' AND t.path = 'bb' THEN 1.0 WHEN s.path = t.path THEN 0.75 ELSE 0.25 END AS git,
         len(list_intersect(s.tokens, t.tokens)) / CAST(len(s.tokens) + len(t.tokens) - len(list_intersect(s.tokens, t.tokens)) AS DOUBLE) AS overlap,
         greatest(0.0, least(1.0, (list_inner_product(s.v, t.v) / sqrt(list_inner_product(s.v, s.v)) / sqrt(list_inner_product(t.v, t.v)) + 1) / 2)) AS semantic,
         CASE WHEN regexp_replace(s.code, '^\s+|\s+$', '', 'g') = regexp_replace(t.code, '^\s+|\s+$', '', 'g') THEN 'likely_unchanged' WHEN s.symbol <> t.symbol OR s.path <> t.path THEN 'likely_renamed_or_moved' ELSE 'likely_modified' END AS change
  FROM messages s JOIN messages t USING (pair_id) WHERE s.role = 'user' AND t.role = 'assistant'),
pool AS (SELECT *, row_number() OVER (PARTITION BY pair_id, s_chunk_id ORDER BY round(CAST(0.20 * file_path + 0.22 * symbol + 0.18 * structure + 0.25 * overlap + 0.15 * git AS DOUBLE), 9) DESC, t_chunk_id) AS place FROM met QUALIFY place <= 50),
rated AS (SELECT *, round(CAST(0.55 * semantic + 0.15 * file_path + 0.10 * symbol + 0.12 * structure + 0.08 * git AS DOUBLE), 9) AS similarity FROM pool),
compared AS (SELECT *, row_number() OVER (PARTITION BY pair_id, s_chunk_id ORDER BY similarity DESC, t_chunk_id) AS nth FROM rated WHERE similarity >= 0.45 QUALIFY nth <= 3)"""
#: BM25 by each version's own statistics.
SCORED = f"""{TOKENS},
words AS (SELECT version_id, chunk_id, unnest(tokens) AS term FROM tokenized), postings AS (SELECT version_id, chunk_id, term, count(*) AS tf FROM words GROUP BY ALL),
dfs AS (SELECT version_id, term, count(*) AS df FROM postings GROUP BY ALL), docs AS (SELECT *, len(tokens) AS dl FROM tokenized), totals AS (SELECT version_id, count(*) AS n, avg(dl) AS avgdl FROM docs GROUP BY 1),
asked AS (SELECT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark), terms AS (SELECT query_id, term, count(*) AS qtf FROM asked GROUP BY ALL),
scored AS (SELECT query_id, version_id, version_label, chunk_id, file_path, start_line, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM terms JOIN dfs USING (term) JOIN postings USING (version_id, term) JOIN totals USING (version_id) JOIN docs USING (version_id, chunk_id) GROUP BY ALL)"""
#: Consecutive turns of a conversation as versions of one text.
TURNS = f"""turns AS (SELECT conv_id, turn, role, text, {tokens('text')} AS tokens FROM conversations),
pairs AS (SELECT a.conv_id, a.turn, a.role AS a_role, b.role AS b_role, a.text AS a_text, b.text AS b_text, list_distinct(a.tokens) AS a, list_distinct(b.tokens) AS b, a.tokens AS a_all, b.tokens AS b_all
  FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

ORACLE_SQL = {
    "source_eligibility": r"""
SELECT doc_id, path, CASE ext WHEN '.py' THEN 'Python' WHEN '.jsx' THEN 'JavaScript' WHEN '.cpp' THEN 'C++' END AS language,
       ext <> '.txt' AND doc_id % 10 <> 0 AND strlen(text) <= 1000000 AS eligible
FROM (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'Vendor/' ELSE '' END || source || '/' || doc_id || ext AS path
      FROM (SELECT *, CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.jsx' WHEN 'de' THEN '.cpp' ELSE '.txt' END AS ext FROM documents))""",
    "stable_chunk_id": f"WITH {CHUNKS} SELECT chunk_id, substr(sha1('repo:' || file_path || ':' || symbol_name || ':' || symbol_type || ':1:1'), 1, 20) AS stable_id FROM chunks",
    "searchable_text": f"WITH {CHUNKS} SELECT chunk_id, md5({SEARCHABLE}) AS text_md5, length({SEARCHABLE}) AS n_chars FROM chunks",
    "tokenize": f"WITH {CHUNKS} SELECT chunk_id, len({tokens('code')}) AS n_tokens, md5(array_to_string({tokens('code')}, ' ')) AS tokens_md5 FROM chunks",
    "metadata_tokens": f"WITH {CHUNKS} SELECT chunk_id, array_to_string({tokens(METADATA)}, ' ') AS tokens FROM chunks",
    "query_language": f"SELECT page_id, {LANGUAGE.replace('query', 'url')} AS named FROM pages",
    "identifier_match": r"""
WITH p AS (SELECT p_partkey, lower(replace(p_name, ' ', '.')) AS symbol, lower(split_part(p_name, ' ', 2)) AS word FROM part),
s AS (SELECT *, 'where is ' || CASE p_partkey % 3 WHEN 0 THEN word WHEN 1 THEN word || '_x' ELSE symbol END || '?' AS said FROM p)
SELECT p_partkey, regexp_matches(said, '(^|[^a-z0-9_])' || replace(symbol, '.', '\.') || '([^a-z0-9_]|$)') OR regexp_matches(said, '(^|[^a-z0-9_])' || word || '([^a-z0-9_]|$)') AS named FROM s""",
    "language_map": f"SELECT page_id, [{', '.join(repr(LANGUAGES.get(e.lower())) if e.lower() in LANGUAGES else 'NULL' for e in [*LANGUAGES, '.PY', '.txt', ''])}][page_id % {len(LANGUAGES) + 3} + 1] AS language FROM pages",
    "doc_stats": f"WITH {POSTINGS} SELECT chunk_id, dl FROM doc_stats",
    "term_stats": f"WITH {POSTINGS} SELECT term, df FROM term_stats",
    "corpus_stats": f"WITH {POSTINGS} SELECT n, round(avgdl, 6) AS avgdl FROM corpus",
    "postings": f"WITH {POSTINGS} SELECT chunk_id, term, tf FROM postings",
    "bm25_batch": f"WITH {BM25} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM lexical_top WHERE rank <= 10",
    "vector_normalize": f"WITH {UNIT} SELECT vec_id, round(v[1], 6) AS first_value, round(list_inner_product(v, v), 6) AS squared FROM unit",
    "semantic_topk": f"WITH {UNIT}, s AS (SELECT q.vec_id AS query_id, u.vec_id AS chunk_id, round(list_inner_product(q.v, u.v), 9) AS score FROM unit q, unit u WHERE q.vec_id % 50 = 0) SELECT query_id, chunk_id, row_number() OVER w AS rank, round(score, 6) AS score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id) QUALIFY rank <= 10",
    "minmax_normalize": f"WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice AS score FROM orders) SELECT o_custkey, o_orderkey, round({MINMAX}, 6) AS normalized FROM r WINDOW w AS (PARTITION BY o_custkey)",
    "dedupe_by_id": "SELECT user_id, event_type, max(value) AS score FROM events GROUP BY ALL",
    "hybrid_fusion": f"WITH {FUSED} SELECT query_id, chunk_id, round(score, 6) AS score, round(nl, 6) AS normalized_lexical, round(ns, 6) AS normalized_semantic FROM fused",
    "hybrid_topk": f"WITH {FUSED} SELECT query_id, chunk_id, row_number() OVER w AS rank, round(score, 6) AS score, round(nl, 6) AS normalized_lexical, round(ns, 6) AS normalized_semantic, lexical_rank, semantic_rank FROM fused WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 9) DESC, lower(file_path), start_line, chunk_id) QUALIFY rank <= 10",
    "rerank_features": f"WITH {FEATURES} SELECT query_id, chunk_id, " + ", ".join(f"round({x}, 6) AS {x}" for x in ("semantic", "lexical", "exact_symbol", "filename", "language", "intent", "metadata")) + " FROM rated",
    "rerank_topk": f"WITH {RERANKED} SELECT query_id, chunk_id, row_number() OVER w AS rank, round(score, 6) AS score FROM final WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 9) DESC, lower(file_path), start_line, chunk_id) QUALIFY rank <= 10",
    "evaluate_ndcg_mrr": f"""
WITH {BM25}, j AS (SELECT query_id, chunk_id, quality AS grade, rank FROM lexical_top JOIN labels ON CAST(doc_id AS VARCHAR) = chunk_id),
ideal AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(place + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, chunk_id) AS place FROM j) WHERE place <= 10 GROUP BY 1),
met AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) END) AS dcg, min(CASE WHEN grade > 0 THEN rank END) AS first FROM j GROUP BY 1)
SELECT query_id, round(CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END, 6) AS ndcg, round(coalesce(1.0 / first, 0), 6) AS rr FROM ideal LEFT JOIN met USING (query_id)""",
    "symbol_resolution": f"WITH {GRAPH} SELECT chunk_id, name, target FROM ({resolved('called')})",
    "graph_nodes": f"WITH {PARTS} SELECT 'symbol::' || chunk_id AS node_id, 'symbol' AS kind, symbol_name, file_path FROM chunks UNION ALL SELECT DISTINCT 'file::' || file_path, 'file', NULL, file_path FROM chunks",
    "graph_contains": f"WITH {GRAPH} SELECT source, target FROM contains_",
    "graph_calls": f"WITH {GRAPH} SELECT source, target FROM calls_",
    "graph_references": f"WITH {MODULES} SELECT DISTINCT 'symbol::' || chunk_id AS source, 'symbol::' || target AS target FROM ({resolved('named')}) WHERE target <> chunk_id",
    "graph_inherits": f"WITH {MODULES} SELECT DISTINCT 'symbol::' || chunk_id AS source, 'symbol::' || target AS target FROM ({resolved('based', 'class_local', 'class_anywhere')}) WHERE target IS NOT NULL",
    "graph_imports": f"WITH {MODULES} SELECT DISTINCT 'file::' || stems.file_path AS source, 'file::' || chunks.file_path AS target FROM stems JOIN chunks ON chunks.file_path = stem || '.py'",
    "graph_expand": f"WITH RECURSIVE {WALKS} SELECT query_id, seed, node_id, hops, array_to_string(said, '; ') AS relation_path, CAST(1.0 AS DOUBLE) / hops AS graph_score FROM near",
    "graph_summary": f"WITH {GRAPH} SELECT 'relation' AS what, relation AS name, count(*) AS total FROM relations GROUP BY 2 UNION ALL SELECT 'edges', 'all', count(*) FROM edges UNION ALL SELECT 'nodes', 'all', count(*) + (SELECT count(DISTINCT file_path) FROM chunks) FROM chunks UNION ALL SELECT 'kind', 'symbol', count(*) FROM chunks UNION ALL SELECT 'kind', 'file', count(DISTINCT file_path) FROM chunks",
    "graph_neighbors": f"WITH {GRAPH} SELECT target AS node_id, 'incoming' AS direction, relation, source AS other FROM edges WHERE target LIKE 'symbol::%' UNION ALL SELECT source, 'outgoing', relation, target FROM edges WHERE source LIKE 'symbol::%'",
    "version_list": "SELECT lang AS version_id, 'lang ' || lang AS version_label, count(*) AS number_of_chunks, count(DISTINCT source) AS number_of_folders FROM documents GROUP BY lang",
    "multi_pass": f"WITH {MULTI_PASS} SELECT query_id, chunk_id, rank, round(score, 6) AS score, pass1, seeds, expansions, added, pass5 FROM results JOIN report USING (query_id)",
    "version_select": "SELECT lang AS version_id, source AS folder, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY ALL",
    "version_compare": f"WITH {MESSAGES} SELECT pair_id, s_chunk_id, t_chunk_id, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in ('similarity', 'semantic', 'file_path', 'symbol', 'structure', 'git'))}, change FROM compared",
    "greedy_match": f"""
WITH RECURSIVE {MESSAGES},
listed AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY similarity DESC, s_chunk_id, t_chunk_id) AS k FROM compared),
taking AS (
  SELECT DISTINCT pair_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS s_chunk_id, CAST(NULL AS VARCHAR) AS t_chunk_id, CAST(NULL AS DOUBLE) AS similarity, FALSE AS taken FROM listed
  UNION ALL SELECT l.pair_id, l.k, CASE WHEN list_has_any(used, [l.s_chunk_id, l.t_chunk_id]) THEN used ELSE used || [l.s_chunk_id, l.t_chunk_id] END, l.s_chunk_id, l.t_chunk_id, CAST(l.similarity AS DOUBLE), NOT list_has_any(used, [l.s_chunk_id, l.t_chunk_id])
  FROM taking g JOIN listed l ON l.pair_id = g.pair_id AND l.k = g.k + 1)
SELECT pair_id, s_chunk_id, t_chunk_id, round(similarity, 6) AS similarity FROM taking WHERE taken""",
    "version_search_hybrid": f"""
WITH {SCORED},
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, version_id ORDER BY round(score, 9) DESC, lower(file_path), start_line, chunk_id) AS nth FROM scored QUALIFY nth <= 50),
{UNIT},
vector_scores AS (
  SELECT item_id AS query_id, lang AS version_id, CAST(u.vec_id AS VARCHAR) AS chunk_id, round(list_inner_product(q.v, u.v), 9) AS score FROM benchmark JOIN unit q ON q.vec_id = item_id, unit u JOIN documents ON doc_id = u.vec_id),
vector_best AS (SELECT *, row_number() OVER (PARTITION BY query_id, version_id ORDER BY score DESC, chunk_id) AS nth FROM vector_scores QUALIFY nth <= 50),
l AS (SELECT query_id, version_id, chunk_id, {MINMAX} AS nl FROM best WINDOW w AS (PARTITION BY query_id, version_id)),
s AS (SELECT query_id, version_id, chunk_id, {MINMAX} AS ns FROM vector_best WINDOW w AS (PARTITION BY query_id, version_id)),
both_ AS (SELECT query_id, version_id, chunk_id, round((coalesce(nl, 0) + coalesce(ns, 0)) / 2, 9) AS relevance FROM l FULL JOIN s USING (query_id, version_id, chunk_id)),
placed AS (SELECT b.*, version_label, file_path, start_line FROM both_ b JOIN chunks c ON c.version_id = b.version_id AND c.chunk_id = b.chunk_id)
SELECT query_id, version_id, chunk_id, row_number() OVER w AS rank, round(relevance, 6) AS relevance FROM placed
WINDOW w AS (PARTITION BY query_id ORDER BY relevance DESC, version_label, lower(file_path), start_line, chunk_id, version_id) QUALIFY rank <= 10""",
    "symbol_similarity": f"""
WITH p AS (SELECT p_partkey, p_name AS x, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS y FROM part),
n AS (SELECT p_partkey, upper(left(x, 1)) || lower(replace(substr(x, 2), ' ', '_')) AS x, upper(left(y, 1)) || lower(replace(substr(y, 2), ' ', '_')) AS y FROM p WHERE y IS NOT NULL),
t AS (SELECT p_partkey, list_distinct({tokens('x')}) AS a, list_distinct({tokens('y')}) AS b FROM n)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS similarity FROM t""",
    "structure_similarity": """
WITH m AS (
  SELECT p_partkey, p_brand, CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'method' END AS kind, list_distinct(string_split(p_name || ' ' || p_type, ' ')) AS words,
         CASE WHEN p_size % 5 > 0 THEN p_size % 7 END AS arity, p_partkey % 9 AS calls, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
j AS (SELECT a.*, b.kind AS kind_b, b.arity AS arity_b, b.calls AS calls_b, list_intersect(a.words, b.words) AS common, list_distinct(a.words || b.words) AS either FROM m a JOIN m b ON a.p_brand = b.p_brand AND b.k = a.k + 1)
SELECT p_partkey, round(0.45 * CASE WHEN kind = kind_b THEN 1.0 WHEN 'class' NOT IN (kind, kind_b) THEN 0.5 ELSE 0.0 END
  + 0.30 * coalesce(list_sum(list_transform(common, lambda w: length(w) % 4 + 1)), 0) / list_sum(list_transform(either, lambda w: length(w) % 4 + 1))
  + 0.15 * CASE WHEN arity IS NULL OR arity_b IS NULL THEN 0.5 ELSE 1 - abs(arity - arity_b) / greatest(arity, arity_b, 1) END
  + 0.10 * (1 - abs(calls - calls_b) / greatest(calls, calls_b, 1)), 6) AS similarity FROM j""",
    "version_search": f"""
WITH {SCORED},
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, version_id ORDER BY round(score, 9) DESC, lower(file_path), start_line, chunk_id) AS nth FROM scored QUALIFY nth <= 50),
normal AS (SELECT *, round({MINMAX}, 9) AS relevance FROM best WINDOW w AS (PARTITION BY query_id, version_id))
SELECT query_id, version_id, chunk_id, row_number() OVER w AS rank, round(relevance, 6) AS relevance FROM normal
WINDOW w AS (PARTITION BY query_id ORDER BY relevance DESC, version_label, lower(file_path), start_line, chunk_id, version_id) QUALIFY rank <= 10""",
    "token_jaccard": f"WITH {TURNS} SELECT conv_id, turn, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS similarity FROM pairs",
    "counter_jaccard": f"""
WITH {TURNS}, w AS (SELECT conv_id, turn, unnest(a_all) AS term, 1 AS x, 0 AS y FROM pairs UNION ALL SELECT conv_id, turn, unnest(b_all), 0, 1 FROM pairs),
c AS (SELECT conv_id, turn, term, sum(x) AS x, sum(y) AS y FROM w GROUP BY ALL), s AS (SELECT conv_id, turn, sum(least(x, y)) / sum(greatest(x, y)) AS similarity FROM c GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(similarity, 0), 6) AS similarity FROM pairs LEFT JOIN s USING (conv_id, turn)""",
    "change_label": f"WITH {TURNS} SELECT conv_id, turn, CASE WHEN trim(a_text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = trim(b_text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) THEN 'likely_unchanged' WHEN a_role <> b_role THEN 'likely_renamed_or_moved' ELSE 'likely_modified' END AS change FROM pairs",
    "git_similarity": """
SELECT l.l_orderkey, l.l_linenumber, CASE WHEN l.l_returnflag <> r.l_returnflag THEN 0.0 WHEN r.l_linenumber = l.l_linenumber + 1 THEN CASE WHEN l.l_suppkey = r.l_suppkey THEN 1.0 WHEN l.l_linestatus = r.l_linestatus THEN 0.75 ELSE 0.25 END ELSE CASE WHEN l.l_linestatus = r.l_linestatus THEN 0.4 ELSE 0.0 END END AS likeness
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) l JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) r ON l.l_orderkey = r.l_orderkey AND r.k = l.k + 1""",
    "topological_order": """
WITH RECURSIVE v AS (SELECT DISTINCT conv_id, turn FROM conversations), o AS (
  SELECT conv_id, turn, 0 AS layer FROM v WHERE NOT EXISTS (SELECT 1 FROM v p WHERE p.conv_id = v.conv_id AND p.turn = v.turn - 1)
  UNION ALL SELECT v.conv_id, v.turn, layer + 1 FROM o JOIN v ON v.conv_id = o.conv_id AND v.turn = o.turn + 1)
SELECT conv_id, turn, layer FROM o""",
    "branching_tracks": """
WITH RECURSIVE hits AS (
  SELECT p_brand AS query_id, p_partkey AS key, round(p_retailprice, 2) AS relevance, row_number() OVER w AS nth, lead(p_partkey) OVER w AS one, CASE WHEN p_partkey % 9 = 0 THEN lead(p_partkey, 2) OVER w END AS two
  FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)),
links AS (SELECT query_id, key AS source, target, round(target % 7 / 7, 6) AS similarity FROM (SELECT query_id, key, nth, unnest([one, two]) AS target FROM hits) WHERE target IS NOT NULL AND nth % 40 <> 0),
steps AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY similarity DESC, CAST(target AS VARCHAR)) AS branch FROM links),
walks AS (
  SELECT query_id, key AS at, [nth] AS route, [CAST(key AS VARCHAR)] AS items, relevance FROM hits WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.query_id = hits.query_id AND l.target = hits.key)
  UNION ALL
  SELECT w.query_id, s.target, list_append(w.route, s.branch), list_append(w.items, CAST(s.target AS VARCHAR)), greatest(w.relevance, h.relevance)
  FROM walks w JOIN steps s ON s.query_id = w.query_id AND s.source = w.at JOIN hits h ON h.query_id = w.query_id AND h.key = s.target),
ended AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY route) AS slot FROM walks w WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.query_id = w.query_id AND s.source = w.at) QUALIFY slot <= 50)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, slot) AS INTEGER) AS track, CAST(relevance AS DOUBLE) AS relevance, len(items) AS n_items, md5(array_to_string(items, ' ')) AS items_md5 FROM ended""",
}
