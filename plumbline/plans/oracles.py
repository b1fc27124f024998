"""The catalogue's queries as SQL for DuckDB, written over joins and windows."""

from __future__ import annotations

from plumbline.plans.catalogue import PART_SCENES, PHRASAL_PREPS, PHRASAL_VERBS, SCENE_WORDS, STOP
from plumbline.plans.tokens import DETERMINERS, HASHED_DEPS, HASHED_POS, PREPOSITIONS, WINDOW

# Fixed value: white space as str.strip() sees it, as a pattern class.
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', '')"


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _words(text: str) -> str:
    return f"string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g')), ' ')"


_TURNS = """
turns AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'evaluator' WHEN 'assistant' THEN 'evaluatee' ELSE role END AS role,
    text AS content
  FROM conversations
)"""


def _shallow(source: str, keys: str, text: str) -> str:
    """Words, chunks, modifiers and relations of the shallow rule."""
    return f"""
w AS (
  SELECT {keys}, unnest({_words(text)}) AS w, unnest(range(len({_words(text)}))) AS i FROM {source}
),
c AS (
  SELECT *, CASE WHEN w IN ({_list(DETERMINERS)}) THEN 'D' WHEN w IN ({_list(PREPOSITIONS)}) THEN 'P' ELSE 'N' END AS c
  FROM w WHERE w <> ''
),
n AS (
  SELECT *, lag(c) OVER o AS p1, lag(w) OVER o AS pw, lead(c) OVER o AS n1, lead(c, 2) OVER o AS n2
  FROM c WINDOW o AS (PARTITION BY {keys} ORDER BY i)
),
r AS (
  SELECT *, sum(CASE WHEN c = 'N' AND p1 IS DISTINCT FROM 'N' THEN 1 ELSE 0 END)
    OVER (PARTITION BY {keys} ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS k
  FROM n
),
chunk AS (
  SELECT {keys}, k, max(i) AS e, max_by(w, i) AS head, max(CASE WHEN p1 = 'D' THEN pw END) AS det,
    string_agg(w, ' ' ORDER BY i) AS span,
    string_agg(CASE WHEN n1 = 'N' THEN w END, ',' ORDER BY i) AS adj
  FROM r WHERE c = 'N' GROUP BY {keys}, k
),
relation AS (
  SELECT r.*, s.head AS subject, o.head AS object
  FROM (SELECT {keys}, k, w AS relation FROM r
        WHERE c = 'P' AND p1 = 'N' AND (n1 = 'N' OR (n1 = 'D' AND n2 = 'N'))) r
  JOIN chunk s USING ({keys}, k)
  JOIN chunk o ON {' AND '.join(f'o.{x.strip()} = r.{x.strip()}' for x in keys.split(','))} AND o.k = r.k + 1
)"""


_DOCUMENT = "WITH " + _shallow("documents", "doc_id", "text")

_CONVERSATION = (
    "WITH "
    + _TURNS
    + """, said AS (
  SELECT conv_id, turn, CASE role WHEN 'evaluator' THEN 'gt' ELSE 'vlm' END AS side, content FROM turns
  WHERE role IN ('evaluator', 'evaluatee')
),"""
    + _shallow("said", "conv_id, turn, side", "content")
    + """,
heads AS (SELECT DISTINCT conv_id, side, head FROM chunk),
attrs AS (
  SELECT DISTINCT conv_id, side, head, unnest(string_split(adj, ',')) AS attr FROM chunk WHERE adj IS NOT NULL
),
missing_attr AS (
  SELECT DISTINCT v.conv_id, v.head FROM attrs v
  WHERE v.side = 'vlm' AND NOT EXISTS (
    SELECT 1 FROM attrs g WHERE g.side = 'gt' AND g.conv_id = v.conv_id AND g.head = v.head AND g.attr = v.attr)
),
bad AS (
  SELECT v.conv_id, v.head, CASE WHEN g.head IS NULL THEN 'object' WHEN m.head IS NOT NULL THEN 'attribute' END AS missing
  FROM heads v
  LEFT JOIN heads g ON g.side = 'gt' AND g.conv_id = v.conv_id AND g.head = v.head
  LEFT JOIN missing_attr m ON m.conv_id = v.conv_id AND m.head = v.head
  WHERE v.side = 'vlm'
),
bad_relation AS (
  SELECT conv_id, subject, relation, object, count(*) AS claims FROM relation v
  WHERE side = 'vlm' AND NOT EXISTS (
    SELECT 1 FROM relation g WHERE g.side = 'gt' AND g.conv_id = v.conv_id
      AND g.subject = v.subject AND g.relation = v.relation AND g.object = v.object)
  GROUP BY ALL
),
scores AS (
  SELECT c.conv_id,
    coalesce(o.objects, 0)::BIGINT AS objects, coalesce(q.relations, 0)::BIGINT AS relations,
    coalesce(o.bad, 0)::BIGINT AS object_hallucination_num, coalesce(b.bad, 0)::BIGINT AS relation_hallucination_num
  FROM (SELECT DISTINCT conv_id FROM said WHERE side = 'vlm') c
  LEFT JOIN (SELECT conv_id, count(*) AS objects, count(missing) AS bad FROM bad GROUP BY 1) o USING (conv_id)
  LEFT JOIN (SELECT conv_id, count(*) AS relations FROM relation WHERE side = 'vlm' GROUP BY 1) q USING (conv_id)
  LEFT JOIN (SELECT conv_id, sum(claims) AS bad FROM bad_relation GROUP BY 1) b USING (conv_id)
)"""
)


def _case(expression: str, values: list[str]) -> str:
    return f"(ARRAY[{_list(values)}])[({expression}) + 1]"


_HASHED = f"""
WITH RECURSIVE
d AS (SELECT doc_id, list_filter({_words('text')}, lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS text, unnest(range(len(ws))) AS i FROM d),
h AS (
  SELECT *,
    (i * 31 + ascii(text) * 17 + length(text) * 7 + doc_id * 1) % 101 AS ha,
    (i * 57 + ascii(text) * 5 + length(text) * 29 + doc_id * 3) % 103 AS hb,
    (i * 11 + ascii(text) * 41 + length(text) * 3 + doc_id * 7) % 107 AS hc,
    i - i % {WINDOW} AS base
  FROM w
),
m AS (SELECT *, base + (doc_id + base) % least({WINDOW}, n - base) AS centre FROM h),
tok AS MATERIALIZED (
  SELECT doc_id, i, text, CASE WHEN text = 'it' THEN '-PRON-' ELSE regexp_replace(text, 's$', '') END AS lemma,
    {_case(f"ha % {len(HASHED_DEPS)}", HASHED_DEPS)} AS dep, {_case(f"hb % {len(HASHED_POS)}", HASHED_POS)} AS pos,
    CASE WHEN i < centre THEN i + 1 + hb % (centre - i) WHEN i > centre THEN i - 1 - hb % (i - centre) ELSE i END AS head,
    hc % 3 = 0 AS is_root, hb % 2 = 0 AS even
  FROM m
),
chunk AS MATERIALIZED (
  SELECT t.doc_id, t.i AS root, t.i + 1 AS stop, t.lemma, t.dep,
    CASE WHEN p.i IS NOT NULL AND NOT p.is_root AND t.even THEN t.i - 1 ELSE t.i END AS start
  FROM tok t LEFT JOIN tok p ON p.doc_id = t.doc_id AND p.i = t.i - 1
  WHERE t.is_root
),
subj AS MATERIALIZED (
  SELECT doc_id, verb, max_by(subject, by_i) AS subject FROM (
    SELECT doc_id, head AS verb, i AS by_i, i AS subject FROM tok WHERE dep = 'nsubj'
    UNION ALL SELECT doc_id, i, i, head FROM tok WHERE dep = 'acl'
    UNION ALL SELECT t.doc_id, v.i, t.i, t.i FROM tok t
      JOIN tok a ON a.doc_id = t.doc_id AND a.i = t.head
      JOIN tok v ON v.doc_id = t.doc_id AND v.i = a.head
      WHERE t.dep = 'pobj' AND a.dep = 'agent' AND v.pos = 'VERB'
  ) GROUP BY doc_id, verb
),
conj AS MATERIALIZED (
  SELECT doc_id, head AS of, i, text, lemma FROM tok WHERE dep = 'conj' AND head <> i
),
x AS (
  SELECT c.doc_id, c.root, d.ws, r.dep AS rdep, h1.i AS i1, h1.text AS t1, h1.lemma AS l1, h1.dep AS d1,
    h2.i AS i2, h2.text AS t2, h2.lemma AS l2, h2.dep AS d2, h2.pos AS p2,
    h3.i AS i3, h3.pos AS p3, h3.head AS i4, s1.subject AS s1, s2.subject AS s2, s3.subject AS s3,
    CASE WHEN h3.i <= h1.i THEN array_to_string(d.ws[h3.i + 1 : h1.i + 1], ' ') ELSE '' END AS phrase
  FROM chunk c
  JOIN d USING (doc_id)
  JOIN tok r ON r.doc_id = c.doc_id AND r.i = c.root
  JOIN tok h1 ON h1.doc_id = c.doc_id AND h1.i = r.head
  JOIN tok h2 ON h2.doc_id = c.doc_id AND h2.i = h1.head
  JOIN tok h3 ON h3.doc_id = c.doc_id AND h3.i = h2.head
  LEFT JOIN subj s1 ON s1.doc_id = c.doc_id AND s1.verb = h1.i
  LEFT JOIN subj s2 ON s2.doc_id = c.doc_id AND s2.verb = h2.i
  LEFT JOIN subj s3 ON s3.doc_id = c.doc_id AND s3.verb = h3.i
),
b AS (
  SELECT *, CASE
    WHEN rdep IN ('dobj', 'attr') THEN CASE WHEN s1 IS NOT NULL THEN 'direct' END
    WHEN rdep = 'nsubjpass' THEN CASE WHEN s1 IS NOT NULL THEN 'direct' END
    WHEN rdep <> 'pobj' OR d1 = 'agent' THEN NULL
    WHEN p2 = 'VERB' AND i2 + 1 = i1 AND l2 || ' ' || l1 IN ({_list(PHRASAL_VERBS)}) AND s2 IS NOT NULL THEN 'phrasal verb'
    WHEN (p2 = 'VERB' OR d2 = 'acl') AND s2 IS NOT NULL THEN 'verb'
    WHEN d2 = 'pobj' AND phrase IN ({_list(PHRASAL_PREPS)}) THEN 'phrasal preposition'
    WHEN p2 = 'NOUN' THEN 'noun'
    WHEN d2 IN ('amod', 'advmod') AND p3 = 'NOUN' THEN 'modifier of noun'
    WHEN d2 IN ('amod', 'advmod') AND p3 = 'VERB' AND s3 IS NOT NULL THEN 'modifier of verb'
    WHEN p2 = 'AUX' AND s2 IS NOT NULL THEN 'copula'
  END AS rule FROM x
),
rel AS MATERIALIZED (
  SELECT b.doc_id, b.root AS object, b.i2, b.rule,
    CASE b.rule WHEN 'direct' THEN s1 WHEN 'phrasal verb' THEN s2 WHEN 'verb' THEN s2 WHEN 'phrasal preposition' THEN i4
      WHEN 'noun' THEN i2 WHEN 'modifier of noun' THEN i3 WHEN 'modifier of verb' THEN s3 ELSE s2 END AS subject,
    CASE WHEN b.rule IN ('phrasal verb', 'modifier of noun', 'modifier of verb') THEN t2 || ' ' || t1
      WHEN b.rule = 'phrasal preposition' THEN phrase ELSE t1 END AS relation,
    CASE WHEN b.rule IN ('phrasal verb', 'modifier of noun', 'modifier of verb') THEN l2 || ' ' || l1
      WHEN b.rule = 'phrasal preposition' THEN
        CASE WHEN i3 < i1 THEN array_to_string(
          list_transform(ws[i3 + 1 : i1], lambda x: CASE WHEN x = 'it' THEN '-PRON-' ELSE regexp_replace(x, 's$', '') END), ' ')
        ELSE '' END
      ELSE l1 END AS lemma_relation
  FROM b WHERE rule IS NOT NULL
),
fake AS (SELECT DISTINCT doc_id, i2 AS i FROM rel WHERE rule = 'phrasal preposition'),
entity AS MATERIALIZED (
  SELECT c.doc_id, c.root, c.start, c.stop,
    row_number() OVER (PARTITION BY c.doc_id ORDER BY c.root) - 1 AS entity_id
  FROM chunk c ANTI JOIN fake f ON f.doc_id = c.doc_id AND f.i = c.root
  WHERE c.lemma <> '-PRON-'
),
up AS (
  SELECT doc_id, i, dep, text, lemma, head AS at, [i] AS path FROM tok
  WHERE dep IN ('det', 'nummod', 'amod', 'compound') AND head <> i
  UNION ALL
  SELECT u.doc_id, u.i, u.dep, u.text, u.lemma, t.head, list_prepend(t.i, u.path)
  FROM up u JOIN tok t ON t.doc_id = u.doc_id AND t.i = u.at
  WHERE t.dep = 'compound' AND t.head <> t.i
)"""


ORACLES: dict[str, str] = {
    "normalise_answers": rf"""WITH {_TURNS}
SELECT conv_id, turn, lower(replace({_strip('content')}, '.', '')) AS output FROM turns WHERE role = 'evaluatee'""",
    "text_edges": rf"""
SELECT doc_id,
  CASE WHEN contains(text, ' the ') THEN split_part(text, ' the ', 1) ELSE text END AS before_marker,
  array_to_string(list_filter({_words('text')}, lambda x: x <> '')[(doc_id % 50) + 1 :], ' ') AS after_prompt,
  list_last(string_split(text, ' ')) AS last_word,
  {_strip('text')} AS stripped
FROM documents""",
    "image_paths": """
WITH p AS (
  SELECT page_id, greatest(length(url), length(html)) AS edge, string_split(CASE page_id % 4
    WHEN 0 THEN url WHEN 1 THEN '/abs/' || page_id WHEN 2 THEN page_id || '.jpg, b/' || page_id || '.png'
    ELSE page_id || '.jpg' END, ',') AS names FROM pages
),
u AS (SELECT page_id, edge, unnest(names) AS name, unnest(range(len(names))) AS image_no FROM p)
SELECT page_id, edge, image_no::INT AS image_no,
  CASE WHEN name LIKE 'http%' OR name LIKE '/%' THEN name ELSE 'data/images/' || name END AS path,
  name LIKE 'http%' AS remote
FROM u""",
    "conversation_styles": """
WITH m AS (
  SELECT p_partkey, lower('x-' || (ARRAY['LLaMA-2','Mistral-v1','v1.6-34b','V1.5','mpt','base'])[p_partkey % 6 + 1] || '-' || p_brand) AS m,
    CASE WHEN p_size % 5 = 0 THEN 'mpt' END AS explicit FROM part
),
s AS (
  SELECT *, CASE WHEN m LIKE '%llama-2%' THEN 'llava_llama_2' WHEN m LIKE '%mistral%' THEN 'mistral_instruct'
    WHEN m LIKE '%v1.6-34b%' THEN 'chatml_direct' WHEN m LIKE '%v1%' THEN 'llava_v1' WHEN m LIKE '%mpt%' THEN 'mpt'
    ELSE 'llava_v0' END AS inferred FROM m
)
SELECT p_partkey, inferred, coalesce(explicit, inferred) AS style, coalesce(explicit <> inferred, false) AS overridden FROM s""",
    "vqa_prompts": rf"""WITH {_TURNS}
SELECT conv_id, turn,
  CASE WHEN contains(content, 'the') THEN replace(content, 'the', '<im>') ELSE '<im>' || chr(10) || content END AS plain,
  CASE WHEN contains(content, 'the') THEN replace(content, 'the', '<s><im></s>') ELSE '<s><im></s>' || chr(10) || content END AS wrapped,
  CASE WHEN contains(content, 'the') THEN replace(content, 'the', '<im>') ELSE '<im>' || content END AS joined
FROM turns WHERE role = 'evaluator'""",
    "lexicon_scan": rf"""
SELECT DISTINCT entry FROM (
  SELECT {_strip('line')} AS entry FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
) WHERE entry <> ''""",
    "scene_flags": f"""
SELECT p_partkey, p_name,
  p_name IN ({_list(PART_SCENES)}) OR list_last(string_split(p_name, ' ')) IN ({_list(PART_SCENES)}) AS scene,
  p_name IN ({_list(PART_SCENES)}) OR list_last(string_split(p_name, ' ')) IN ({_list(PART_SCENES)}) AS scene_inline
FROM part""",
    "assemble_samples": f"""WITH {_TURNS},
i AS (
  SELECT l_orderkey AS image_id, string_agg(
    p_type || ':' || l_quantity::INT || ':' || round(l_extendedprice * 100)::BIGINT, '|'
    ORDER BY l_linenumber, l_partkey, p_type, l_quantity, l_extendedprice) AS instances
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1
),
c AS (SELECT conv_id AS image_id, string_agg(content, '|' ORDER BY turn) AS captions FROM turns GROUP BY 1)
SELECT o_orderkey AS image_id, o_orderkey || '.jpg' AS file_name,
  coalesce(instances, '') AS instances, coalesce(captions, '') AS captions
FROM orders LEFT JOIN i ON i.image_id = o_orderkey LEFT JOIN c ON c.image_id = o_orderkey""",
    "caption_texts": f"""WITH {_TURNS},
c AS (SELECT conv_id AS image_id, string_agg(content, ' ' ORDER BY turn) AS captions FROM turns GROUP BY 1)
SELECT o_orderkey AS image_id, coalesce(captions, '') AS ground_truth
FROM orders LEFT JOIN c ON c.image_id = o_orderkey""",
    "sample_stats": f"""WITH {_TURNS},
i AS (SELECT l_orderkey AS image_id, count(*) AS n, sum(l_extendedprice::DECIMAL(28, 10))::DOUBLE AS a FROM lineitem GROUP BY 1),
c AS (SELECT conv_id AS image_id, count(*) AS n FROM turns GROUP BY 1)
SELECT o_orderkey AS image_id, o_orderkey || '.jpg' AS file_name, coalesce(i.n, 0)::BIGINT AS n_instances,
  coalesce(c.n, 0)::BIGINT AS n_captions, coalesce(i.a, 0.0) AS total_area
FROM orders LEFT JOIN i ON i.image_id = o_orderkey LEFT JOIN c ON c.image_id = o_orderkey""",
    "unknown_categories": """
SELECT l_partkey AS category_id, count(*) AS instances FROM lineitem
WHERE l_partkey NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1""",
    "debug_head": """
SELECT o_orderkey AS image_id, o_orderkey || '.jpg' AS file_name, o_orderkey AS ord FROM orders ORDER BY o_orderkey LIMIT 30""",
    "truncate_at_marker": f"""WITH {_TURNS},
h AS (
  SELECT *, coalesce(bool_or(role = 'evaluator' AND contains(content, '{STOP}')) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM turns
)
SELECT conv_id, turn, role, content FROM h WHERE NOT over""",
    "evaluatee_turns": f"WITH {_TURNS} SELECT * FROM turns WHERE role = 'evaluatee'",
    "transcript_lists": f"""WITH {_TURNS}
SELECT conv_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS conversation FROM turns GROUP BY 1""",
    "transcript_turns": f"""WITH {_TURNS}
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS turn, role, content FROM turns""",
    "grader_prompts": f"""WITH {_TURNS},
n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS n FROM turns)
SELECT conv_id, n AS turn,
  'system=You judge whether statements about an image are supported by its description.' || chr(10) || 'user=about '
  || '{{"conv_id":' || conv_id || ',"file_name":"' || conv_id || '.jpg"}}' || ' {{exactly}}: ' || content AS messages
FROM n WHERE role = 'evaluatee'""",
    "grade_parse": """
WITH k AS (SELECT event_id, event_type, (props->>'$.k')::INT AS k FROM events),
g AS (
  SELECT event_id, unnest(CASE event_id % 6 WHEN 0 THEN [0, 1] WHEN 5 THEN []::INT[] ELSE [0] END) AS ord, event_type, k FROM k
)
SELECT event_id, ord, CASE WHEN event_id % 6 = 3 THEN 'q' ELSE event_type END AS sentence, k AS result_type,
  CASE WHEN event_id % 6 <> 3 THEN 'r' || k END AS reason
FROM g""",
    "grading_lists": """
WITH k AS (SELECT event_id, user_id, event_type, (props->>'$.k')::INT AS k FROM events),
g AS (
  SELECT event_id, user_id, CASE WHEN event_id % 6 = 3 THEN 'q:' || k ELSE event_type || ':' || k || ':r' || k END AS one FROM k
  WHERE event_id % 6 <> 5
)
SELECT user_id, string_agg(CASE WHEN event_id % 6 = 0 THEN one || ',' || one ELSE one END, ',' ORDER BY event_id) AS grading_results
FROM g GROUP BY 1""",
    "graph_entities": _DOCUMENT
    + """
SELECT doc_id, k::INT AS entity_id, head, concat_ws(' ', det, span) AS span, concat_ws(',', det, adj) AS modifiers FROM chunk""",
    "graph_relations": _DOCUMENT + " SELECT doc_id, subject, relation, object FROM relation",
    "graph_endpoints": _DOCUMENT + " SELECT doc_id, subject, relation, object FROM relation",
    "rule_entities": _HASHED
    + f""",
members AS (SELECT e.doc_id, e.entity_id, u.* EXCLUDE (doc_id) FROM entity e JOIN up u ON u.doc_id = e.doc_id AND u.at = e.root),
mods AS (
  SELECT doc_id, entity_id, string_agg(m, ',' ORDER BY path, y) AS modifiers FROM (
    SELECT doc_id, entity_id, path, -1 AS y, dep || ':' || text || ':' || lemma AS m FROM members WHERE dep <> 'compound'
    UNION ALL
    SELECT m.doc_id, m.entity_id, m.path, c.i, 'amod:' || c.text || ':' || c.lemma
    FROM members m JOIN conj c ON c.doc_id = m.doc_id AND c.of = m.i WHERE m.dep = 'amod'
  ) GROUP BY 1, 2
),
names AS (
  SELECT doc_id, entity_id, string_agg(text, ' ' ORDER BY path DESC) AS text, string_agg(lemma, ' ' ORDER BY path DESC) AS lemma
  FROM members WHERE dep = 'compound' GROUP BY 1, 2
),
named AS (
  SELECT e.doc_id, e.entity_id::INT AS entity_id, concat_ws(' ', p.text, r.text) AS span, concat_ws(' ', p.lemma, r.lemma) AS lemma_span,
    concat_ws(' ', n.text, r.text) AS head, concat_ws(' ', n.lemma, r.lemma) AS lemma_head,
    e.start::INT AS span_start, e.stop::INT AS span_end, coalesce(m.modifiers, '') AS modifiers
  FROM entity e
  JOIN tok r ON r.doc_id = e.doc_id AND r.i = e.root
  LEFT JOIN tok p ON p.doc_id = e.doc_id AND p.i = e.start AND e.start < e.root
  LEFT JOIN names n ON n.doc_id = e.doc_id AND n.entity_id = e.entity_id
  LEFT JOIN mods m ON m.doc_id = e.doc_id AND m.entity_id = e.entity_id
)
SELECT *, CASE WHEN lemma_head IN ({_list(SCENE_WORDS)}) OR list_last(string_split(lemma_head, ' ')) IN ({_list(SCENE_WORDS)})
  THEN 'scene' ELSE 'unknown' END AS type FROM named""",
    "rule_relations": _HASHED
    + """,
ends AS (SELECT doc_id, i AS of, i FROM tok UNION ALL SELECT doc_id, of, i FROM conj),
cover AS (
  SELECT doc_id, entity_id, root AS i FROM entity
  UNION ALL SELECT doc_id, entity_id, start FROM entity WHERE start < root
)
SELECT r.doc_id, se.entity_id::INT AS subject, oe.entity_id::INT AS object, r.relation, r.lemma_relation
FROM rel r
JOIN ends s ON s.doc_id = r.doc_id AND s.of = r.subject
JOIN ends o ON o.doc_id = r.doc_id AND o.of = r.object
JOIN cover se ON se.doc_id = r.doc_id AND se.i = s.i
JOIN cover oe ON oe.doc_id = r.doc_id AND oe.i = o.i""",
    "merged_entities": _DOCUMENT
    + """
SELECT doc_id, head, coalesce(string_agg(adj, ',' ORDER BY k), '') AS attributes FROM chunk GROUP BY doc_id, head""",
    "judge_scores": _CONVERSATION + " SELECT * FROM scores",
    "metric_report": _CONVERSATION
    + """
SELECT count(*) AS cases, sum(object_hallucination_num)::BIGINT AS object_hallucination_num,
  sum(relation_hallucination_num)::BIGINT AS relation_hallucination_num FROM scores""",
    "object_hallucination": _CONVERSATION + " SELECT conv_id, head, missing FROM bad WHERE missing IS NOT NULL",
    "relation_hallucination": _CONVERSATION + " SELECT * FROM bad_relation",
    "probe_scores": r"""
WITH p AS (
  SELECT lang AS probe_set, source AS model, quality = 1 AS actual,
    NOT regexp_matches(lower(split_part(text, '.', 1)), '(^|[^a-z])(no|not)($|[^a-z])') AS predicted
  FROM documents JOIN labels USING (doc_id)
),
t AS (
  SELECT probe_set, model, count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp,
    count(*) FILTER (NOT predicted AND NOT actual) AS tn, count(*) FILTER (NOT predicted AND actual) AS fn
  FROM p GROUP BY 1, 2
)
SELECT *, (tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0) AS accuracy, tp::DOUBLE / nullif(tp + fp, 0) AS precision,
  tp::DOUBLE / nullif(tp + fn, 0) AS recall, (2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1,
  (tp + fp)::DOUBLE / nullif(tp + fp + tn + fn, 0) AS yes_ratio
FROM t""",
    "batch_inference": """
SELECT doc_id, source, 'yes ' || doc_id || 'jpg has ' || length(text) || ' letters' AS output FROM documents""",
    "result_round_trip": f"""WITH {_TURNS}
SELECT conv_id || '.jpg' AS image, content AS question, turn,
  'yes ' || conv_id || 'jpg has ' || length(content) || ' letters' AS output FROM turns""",
    "json_array_scan": f"""WITH {_TURNS}
SELECT conv_id || '.jpg' AS image, content AS question, turn, role AS roles,
  'yes ' || conv_id || 'jpg has ' || length(content) || ' letters' AS output FROM turns""",
    "annotation_scan": """
SELECT l_orderkey AS image_id, l_partkey::INT AS category_id, p_type AS name,
  round(l_quantity * 100)::BIGINT || ',' || round(l_extendedprice * 100)::BIGINT AS bbox, round(l_extendedprice * 100)::BIGINT AS area
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""",
    "image_id_scan": "SELECT o_orderkey AS image_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord FROM orders",
    "chat_replies": f"""WITH {_TURNS}
SELECT conv_id, turn,
  CASE WHEN length(content) % 7 <> 0 THEN 'm got 2 messages, ' || length(content) || ' letters' END AS reply,
  CASE WHEN length(content) % 7 = 0 THEN 'RuntimeError: unavailable' END AS reply_error
FROM turns""",
    "annotated_turns": f"""WITH {_TURNS}
SELECT conv_id, turn, len(string_split(lower(content), ' '))::INT AS n_tokens,
  array_to_string(list_filter(string_split(lower(content), ' '), lambda x: length(x) > 3), ' ') AS heads
FROM turns""",
    "dialogues": """
WITH q AS (
  SELECT c_custkey, unnest(range(1, 4)) AS n, c_custkey % 4 AS k FROM customer
),
a AS (
  SELECT c_custkey, string_agg(
    'evaluator: Question ' || n || ' about ' || c_custkey || '?' || chr(10) ||
    'evaluatee: yes data/val/' || c_custkey || 'jpg: question ' || n || ' about ' || c_custkey || '? fine', chr(10) ORDER BY n
  ) AS said FROM q WHERE n <= k GROUP BY 1
)
SELECT c.c_custkey,
  concat_ws(chr(10), said, CASE WHEN c.c_custkey % 4 < 3 THEN 'evaluator: END' END) AS conversation,
  CASE WHEN c.c_custkey % 4 < 3 THEN 'ended' ELSE 'max_turns' END AS status
FROM customer c LEFT JOIN a USING (c_custkey)""",
    "nested_parts": f"""WITH {_TURNS},
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM turns)
SELECT conv_id, (p // 3)::INT AS part, min(p) AS first_position,
  string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS conversation
FROM n GROUP BY conv_id, p // 3""",
    "sample_parts": f"""WITH {_TURNS},
a AS (
  SELECT l_orderkey AS image_id, 0 AS kind, l_linenumber AS x, l_partkey AS y, NULL AS caption FROM lineitem
  UNION ALL SELECT conv_id, 1, turn, 0, content FROM turns
),
n AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY kind, x, y) - 1) // 2 AS part FROM a),
g AS (
  SELECT image_id, part, count(*) FILTER (kind = 0) AS n, string_agg(caption, '|' ORDER BY x) FILTER (kind = 1) AS captions
  FROM n GROUP BY 1, 2
)
SELECT o_orderkey AS image_id, coalesce(part, 0)::INT AS part, coalesce(n, 0)::INT AS n_instances, coalesce(captions, '') AS captions
FROM orders LEFT JOIN g ON g.image_id = o_orderkey""",
    "grading_parts": """
WITH k AS (
  SELECT event_id, user_id, event_type, (props->>'$.k')::INT AS k,
    (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS part FROM events
),
g AS (
  SELECT *, CASE event_id % 6 WHEN 5 THEN NULL WHEN 3 THEN 'q:' || k ELSE event_type || ':' || k || ':r' || k END AS one FROM k
)
SELECT user_id, part::INT AS part,
  coalesce(string_agg(CASE WHEN event_id % 6 = 0 THEN one || ',' || one ELSE one END, ',' ORDER BY event_id), '') AS grading_results
FROM g GROUP BY user_id, part""",
    "debug_samples": f"""WITH {_TURNS},
few AS (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30)
SELECT o_orderkey AS image_id, o_orderkey || '.jpg' AS file_name,
  (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::INT AS n_instances,
  coalesce((SELECT string_agg(content, '|' ORDER BY turn) FROM turns WHERE conv_id = o_orderkey), '') AS captions
FROM few""",
    "merged_table": _DOCUMENT
    + """,
placed AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, head ORDER BY k) - 1) // 3 AS part FROM chunk)
SELECT doc_id, head, part::INT AS part, coalesce(string_agg(adj, ',' ORDER BY k), '') AS attributes FROM placed GROUP BY doc_id, head, part""",
    "graded_repeats": f"""WITH {_TURNS},
g AS (SELECT *, role = 'evaluatee' AND length(content) % 11 <> 0 AS ok FROM turns)
SELECT conv_id % 3 || '.jpg' AS file_name, count(*)::INT AS turns, count(*) FILTER (ok)::INT AS gradings,
  count(*) FILTER (role = 'evaluatee' AND NOT ok) AS ungraded,
  coalesce(string_agg(length(content) || ' letters', ',' ORDER BY turn) FILTER (ok), '') AS sentences
FROM g GROUP BY conv_id""",
    "attached_images": """
SELECT page_id, coalesce(a.p_name, '-') || '|' || coalesce(b.p_name, '-') AS contents
FROM pages LEFT JOIN part a ON a.p_partkey = page_id LEFT JOIN part b ON b.p_partkey = page_id * 9""",
    "graded_samples": f"""WITH {_TURNS},
g AS (
  SELECT conv_id, turn, length(content) AS n, length(content) % 11 <> 0 AS ok FROM turns WHERE role = 'evaluatee'
),
s AS (
  SELECT conv_id, string_agg(CASE WHEN ok THEN n || ' letters:' || (n % 3) || ':g' END, ',' ORDER BY turn) AS gr,
    count(*) FILTER (NOT ok) AS ungraded FROM g GROUP BY 1
)
SELECT t.conv_id, coalesce(gr, '') AS grading_results, coalesce(ungraded, 0)::BIGINT AS ungraded
FROM (SELECT DISTINCT conv_id FROM turns) t LEFT JOIN s USING (conv_id)""",
}

# the same rows by other means
ORACLES["rule_relations_joined"] = ORACLES["located_relations"] = ORACLES["rule_relations"]
ORACLES["rule_types_joined"] = f"SELECT doc_id, entity_id, lemma_head, type FROM ({ORACLES['rule_entities']})"
ORACLES["probe_sets"] = """
WITH own AS (SELECT DISTINCT l_orderkey AS image, p_type AS object FROM lineitem JOIN part ON p_partkey = l_partkey),
rk AS (SELECT object, row_number() OVER (ORDER BY count(*) DESC, object) AS rank FROM own GROUP BY object),
p AS (SELECT image, rank FROM own JOIN rk USING (object)),
lacking AS (SELECT image, rk.rank FROM (SELECT DISTINCT image FROM p) i, rk ANTI JOIN p ON p.image = i.image AND p.rank = rk.rank),
beside AS (SELECT a.rank, b.rank AS other, count(*) AS n FROM p a JOIN p b ON a.image = b.image AND a.rank <> b.rank GROUP BY ALL),
near AS (
  SELECT p.image, other AS rank, max(n) AS n FROM p JOIN beside USING (rank) JOIN lacking l ON l.image = p.image AND l.rank = other GROUP BY ALL
),
chosen AS (
  SELECT image, s AS probe_set, 'yes' AS label, row_number() OVER (PARTITION BY image, s ORDER BY rank) - 1 AS place, rank
  FROM p, (VALUES ('random'), ('popular'), ('adversarial')) v(s)
  UNION ALL SELECT image, 'popular', 'no', row_number() OVER (PARTITION BY image ORDER BY rank) - 1, rank FROM lacking
  UNION ALL SELECT image, 'random', 'no', row_number() OVER (PARTITION BY image ORDER BY (rank - 1 + c - image * 48271 % c) % c) - 1, rank
  FROM lacking, (SELECT count(*) AS c FROM rk)
  UNION ALL SELECT image, 'adversarial', 'no', row_number() OVER (PARTITION BY image ORDER BY n DESC, rank) - 1, rank FROM near
)
SELECT image AS l_orderkey, probe_set, place::INT AS place, object, label, 'Is there a ' || object || ' in the image?' AS question
FROM chosen JOIN rk USING (rank) WHERE place < 3"""
