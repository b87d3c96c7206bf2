"""The data model of sources.views as common table expressions, for the equivalent SQL."""

ISO = "%Y-%m-%dT%H:%M:%S.%f"


def iso(column: str) -> str:
    return f"strftime({column}, '{ISO}')"


VIEWS = {
    "statements": """
 SELECT 'stmt_' || event_id AS statement_id, 'space_' || (user_id % 4) AS space_id, 'user:' || user_id AS subject_id,
  CASE event_type WHEN 'view' THEN 'likes' WHEN 'click' THEN 'uses' WHEN 'purchase' THEN 'owns' WHEN 'signup' THEN 'works_at' WHEN 'error' THEN 'has_symptom' END AS predicate,
  'item:' || regexp_extract(props, '[0-9]+') AS object_id, CASE WHEN event_id % 3 = 0 THEN 'owner' ELSE 'companion:c' || (event_id % 2) END AS audience,
  CASE WHEN event_id % 50 <> 0 THEN ts END AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to, ts AS recorded_at,
  CAST(event_id % 10 AS DOUBLE) / 10 AS confidence, event_type = 'error' AS sensitive, 'turn_' || (event_id % 500) AS source_turn_id, CASE WHEN event_id % 40 = 0 THEN 'fact_' || (event_id % 400) END AS projection_id FROM events""",
    "spaces": "SELECT 'space_' || unnest(range(4)) AS space_id",
    "entities": """
 SELECT DISTINCT space_id, e AS entity_id, e AS name FROM (SELECT 'space_' || (user_id % 4) AS space_id, 'user:' || user_id AS e FROM events UNION ALL SELECT 'space_' || (user_id % 4), 'item:' || regexp_extract(props, '[0-9]+') FROM events)
 UNION ALL SELECT space_id, 'nation:' || n_nationkey, lower(n_name) FROM nation, spaces""",
    "mentions": "SELECT space_id, 'nation:' || n_nationkey AS entity_id, 'land ' || substr(lower(n_name), 1, 4) AS alias, CASE n_nationkey % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence, CASE WHEN n_nationkey % 5 = 4 THEN 'companion:c1' ELSE 'owner' END AS audience FROM nation, spaces",
    "phrases": "SELECT c_custkey AS phrase_id, 'space_' || (c_custkey % 4) AS space_id, 'moved to ' || CASE WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE 'LAND ' || substr(n_name, 1, 4) END || ' near user:' || (c_custkey % 40) AS phrase FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "drawers": """
 SELECT doc_id AS drawer_id, 'space_' || (doc_id % 2) AS space_id,
  (['Wing_Profile', 'Wing_Interaction', 'Wing_Relationship', 'Wing_Emotion', 'Wing_Future', 'Wing_Event', 'Wing_Work', 'Wing_Life', 'Wing_Health', 'Wing_Privacy', 'Wing_Theme'])[CAST(substr(source, 4) AS INT) % 11 + 1] AS wing,
  lang AS room, source AS source_file, text, embedding::DOUBLE[] AS embedding, CASE WHEN doc_id % 7 <> 0 THEN (['owner', 'companion:c0', 'companion:c1'])[doc_id % 3 + 1] END AS audience,
  (['all_devices', 'all_devices', 'current_device', 'private', 'all_devices'])[doc_id % 5 + 1] AS visibility, (['persona', 'global', 'device', 'agent', 'session', 'other'])[doc_id % 6 + 1] AS scope,
  (['personal', 'household', 'personal', 'personal'])[doc_id % 4 + 1] AS layer, CASE WHEN doc_id % 17 = 0 THEN 'do_not_recall' WHEN doc_id % 11 = 0 THEN 'private' ELSE 'normal' END AS privacy,
  CASE WHEN doc_id % 6 = 4 THEN 'session_' || (doc_id % 3) END AS session_id, CASE WHEN doc_id % 9 = 0 THEN 'person_' || (doc_id % 2) END AS person_id, 'device_' || (doc_id % 4) AS source_device_id,
  'turn_' || (doc_id % 500) AS source_turn_id, CASE WHEN doc_id % 13 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 2000 AS INT)) END AS memory_time,
  CASE WHEN doc_id % 8 = 0 THEN 'device_' || ((doc_id + 1) % 4) ELSE '' END AS target_device_id, (['profile', 'interaction', 'relationship', 'emotion', 'goal', 'event', 'work', 'preference', 'health', 'privacy', 'theme'])[CAST(substr(source, 4) AS INT) % 11 + 1] AS memory_type,
  CASE WHEN doc_id % 23 = 0 THEN 'Archived' END AS room_status, CASE doc_id % 10 WHEN 0 THEN '{"location": {"room": "and"}}' WHEN 1 THEN '{"note": "plain"}' WHEN 2 THEN 'no json' ELSE '{}' END AS extensions, CAST(doc_id % 5 + 1 AS INT) AS importance
 FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
    "closets": "SELECT doc_id AS drawer_id, source AS source_file, embedding::DOUBLE[] AS embedding FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 3 = 1",
    "command_events": """
 SELECT 'req_' || user_id || '_' || (event_id % 20) AS request_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'accepted' WHEN 'click' THEN 'retrying' WHEN 'purchase' THEN 'applied' ELSE 'failed' END AS status FROM events""",
    "dead_letters": """
 SELECT event_id AS entry_id, (['pending', 'claimed', 'resolved', 'pending'])[event_id % 4 + 1] AS state, strlen(props) AS payload_bytes, ts AS created_at FROM events WHERE event_type IN ('error', 'signup')""",
    "sync_events": "SELECT event_id AS seq, 'ev_' || (event_id % 4000) AS event_id, sha256(user_id || ':' || props) AS idempotency_hash FROM events",
    "commitment_events": """
 SELECT o_orderkey AS commitment_id, 'customer:' || o_custkey AS promisor, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS n,
  CASE WHEN l_linestatus = 'F' THEN (['confirmed', 'fulfilled', 'cancelled'])[l_linenumber % 3 + 1] ELSE (['proposed', 'confirmed'])[l_linenumber % 2 + 1] END AS status,
  'supplier:' || l_suppkey AS participant, CASE WHEN l_orderkey % 7 <> 0 THEN l_shipdate END AS due_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
}
VIEWS["canonical_events"] = """
 SELECT 'fact_' || user_id || '_' || (event_id % 10) AS fact_id, 'slot_' || user_id AS slot, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'add' WHEN event_type = 'purchase' THEN 'invalidate' WHEN event_type = 'signup' THEN 'reactivate' WHEN event_id % 20 = 0 THEN 'forget' ELSE 'add' END AS kind,
  CASE WHEN event_type = 'purchase' THEN (['invalidated', 'superseded'])[event_id % 2 + 1] WHEN event_type NOT IN ('view', 'click', 'signup') AND event_id % 20 = 0 THEN (['hard', 'soft'])[(event_id // 20) % 2 + 1] END AS result,
  'intent_' || (event_id % 3000) AS intent_id, 'turn_' || (event_id % 500) AS source, event_id % 7 <> 0 AS applied, (['projected', 'pending', 'not_required'])[event_id % 3 + 1] AS drawer, (['projected', 'pending', 'not_required'])[(event_id // 3) % 3 + 1] AS kg, ts FROM events"""
VIEWS["canonical"] = """
 SELECT fact_id, slot, CASE WHEN bool_or(kind = 'forget') THEN 'forgotten' ELSE coalesce(arg_max(CASE kind WHEN 'invalidate' THEN result ELSE 'active' END, seq) FILTER (applied AND kind IN ('invalidate', 'reactivate') AND counts), 'active') END AS state,
  count(*) FILTER (counts AND kind IN ('add', 'reactivate')) AS evidence, 1 + count(*) FILTER (counts AND kind = 'reactivate' AND applied) AS activations,
  count(*) FILTER (kind = 'invalidate' AND result = 'invalidated' AND applied) AS invalidations, count(*) FILTER (kind = 'invalidate' AND result = 'superseded' AND applied) AS supersessions, count(*) FILTER (counts AND kind = 'reactivate' AND applied) AS reactivations,
  count(*) FILTER (kind = 'invalidate' AND result = 'invalidated' AND NOT applied) AS invalidations_pending, count(*) FILTER (kind = 'invalidate' AND result = 'superseded' AND NOT applied) AS supersessions_pending, count(*) FILTER (counts AND kind = 'reactivate' AND NOT applied) AS reactivations_pending,
  count(*) FILTER (NOT counts) AS rejected, arg_max(drawer, seq) AS drawer, arg_max(kg, seq) AS kg, max(ts) AS updated_at FROM (
  SELECT *, kind <> 'reactivate' OR before <> 'active' AS counts FROM (SELECT *, coalesce(last_value(CASE WHEN applied AND kind = 'invalidate' THEN result WHEN applied AND kind = 'reactivate' THEN 'active' END IGNORE NULLS) OVER (PARTITION BY fact_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'active') AS before FROM (
   SELECT *, min(seq) FILTER (kind = 'forget') OVER (PARTITION BY fact_id) AS until, min(seq) FILTER (kind = 'add') OVER (PARTITION BY fact_id) AS born FROM (SELECT * FROM canonical_events QUALIFY row_number() OVER (PARTITION BY fact_id, kind, intent_id ORDER BY seq) = 1))
   WHERE born IS NOT NULL AND seq >= born AND (until IS NULL OR seq <= until))) GROUP BY 1, 2"""
VIEWS["claims"] = """
 SELECT 'space_' || (user_id % 4) AS space_id, 'turn_' || (event_id % 500) AS turn_id, (['fragment', 'triple', 'invalidation', 'privacy'])[event_id % 4 + 1] AS kind, event_id AS idx, props AS content, props AS user_text,
  CASE WHEN event_id % 3 = 0 THEN 'zz' WHEN event_id % 11 = 0 THEN ' ' ELSE substr(props, 3, 6) END AS evidence_quote, 'user:' || user_id AS subject,
  CASE WHEN event_id % 5 <> 0 THEN CASE event_type WHEN 'view' THEN 'likes' WHEN 'click' THEN 'uses' WHEN 'purchase' THEN 'owns' WHEN 'signup' THEN 'works_at' WHEN 'error' THEN 'has_symptom' END END AS predicate, 'item:' || regexp_extract(props, '[0-9]+') AS object,
  CAST(event_id % 10 AS DOUBLE) / 10 AS confidence, CAST(event_id % 8 AS DOUBLE) / 8 AS fact_confidence, CAST(event_id % 5 + 1 AS INT) AS importance, CASE event_id % 6 WHEN 1 THEN 'household' ELSE 'personal' END AS layer, CASE event_id % 7 WHEN 2 THEN 'device' ELSE 'persona' END AS scope,
  CASE event_id % 13 WHEN 0 THEN 'current_device' ELSE 'all_devices' END AS visibility, CASE WHEN event_id % 17 = 0 THEN 'device_1' ELSE '' END AS target_device_id, CASE event_id % 9 WHEN 0 THEN 'sensitive' WHEN 1 THEN 'private' ELSE 'normal' END AS privacy,
  CASE WHEN event_id % 2 = 0 THEN ts END AS valid_from, ts AS occurred_at FROM events"""
VIEWS["turn_contexts"] = """
 SELECT 'turn_' || (8 * conv_id + turn) AS turn_id, 'space_' || (conv_id % 4) AS space_id, CASE WHEN role = 'user' THEN 'owner' ELSE 'companion:c' || (conv_id % 2) END AS audience, 'device_' || (conv_id % 5) AS device_id, CASE WHEN role = 'system' THEN 'household' ELSE 'personal' END AS layer, CASE WHEN length(text) % 8 <> 0 THEN 'person_' || (conv_id % 3) END AS person_id FROM conversations"""
VIEWS["visible_drawers"] = """
 SELECT * FROM drawers WHERE wing <> 'Wing_Privacy' AND space_id = 'space_0' AND privacy NOT IN ('do_not_recall', 'private') AND visibility <> 'private'
  AND (scope <> 'session' OR session_id = 'session_1') AND (person_id IS NULL OR person_id = 'person_0') AND coalesce(audience, 'owner') IN ('owner', 'companion:c0')
  AND (visibility <> 'current_device' OR source_device_id = 'device_2' OR target_device_id = 'device_2')"""
VIEWS["queries"] = "SELECT item_id AS query_id, text AS query, embedding::DOUBLE[] AS v FROM benchmark LEFT JOIN embeddings ON vec_id = 50 * item_id"
VIEWS["vector"] = """
 SELECT query_id, d.*, round(list_cosine_similarity(embedding, v), 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(embedding, v), 6) DESC NULLS LAST, drawer_id) AS rank
 FROM visible_drawers d CROSS JOIN queries WHERE embedding IS NOT NULL AND v IS NOT NULL"""
VIEWS["words"] = r"SELECT drawer_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_-]+|[^\s\p{Z}a-z0-9_-]') AS w FROM visible_drawers"
VIEWS["lexical"] = r"""
 SELECT query_id, drawer_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, drawer_id) AS rank FROM (
  SELECT query_id, p.drawer_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))), 6) AS score
  FROM (SELECT drawer_id, term, len(any_value(w)) AS size, count(*) AS tf FROM (SELECT drawer_id, w, unnest(w) AS term FROM words) GROUP BY 1, 2) p
  JOIN (SELECT term, count(DISTINCT drawer_id) AS df FROM (SELECT drawer_id, unnest(w) AS term FROM words) GROUP BY 1) USING (term)
  JOIN (SELECT DISTINCT query_id, unnest(regexp_extract_all(translate(query, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_-]+|[^\s\p{Z}a-z0-9_-]')) AS term FROM queries) USING (term)
  CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS mean FROM words) GROUP BY 1, 2)"""
VIEWS["fused"] = """
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, v_rank ASC NULLS LAST, drawer_id) AS rank FROM (
  SELECT query_id, drawer_id, v.similarity, v.rank AS v_rank, x.rank AS l_rank, round(coalesce(1.0::DOUBLE / (60 + v.rank - 1), 0) + coalesce(1.0::DOUBLE / (60 + x.rank - 1), 0), 9) AS rrf
  FROM (SELECT * FROM vector WHERE rank <= 30) v FULL JOIN (SELECT * FROM lexical WHERE rank <= 30) x USING (query_id, drawer_id))) WHERE rank <= 20"""
VIEWS["placed"] = """
 SELECT * FROM (SELECT f.*, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, rank) AS place FROM fused f JOIN (SELECT drawer_id,
  CASE WHEN scope = 'device' AND 'device_2' IN (source_device_id, target_device_id) THEN 0.9 WHEN scope IN ('global', 'persona') THEN 0.75 WHEN scope = 'agent' THEN 0.7 WHEN scope = 'device' THEN 0.25 ELSE 0.5 END AS tier FROM visible_drawers) USING (drawer_id)) WHERE place <= 8"""

NEEDS = {"canonical": ["canonical_events"], "entities": ["spaces"], "mentions": ["spaces"], "visible_drawers": ["drawers"], "vector": ["visible_drawers", "queries"], "words": ["visible_drawers"], "lexical": ["words", "queries"], "fused": ["vector", "lexical"], "placed": ["fused", "visible_drawers"]}


def sql(views: str, select: str) -> str:
    """select over the named views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in views.split():
        add(name)
    return ("WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order) + "\n" if order else "") + select
