"""Registered queries on storage, wording, steward claims, the canonical ledger and quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.functions import text
from recallspark.operators import browse, canonical, erasure, evaluation, graph, graph_recall, ledgers, ontology, postings, recall, retrieval, steward, storage, vector_index, visibility
from recallspark.operators.scratch import written
from recallspark.plans.catalog import _ORDER, _RENDERED, _SEEN, _STEP, _TEXTS, _VALID, CALLER, ORACLES, READERS, SPACE, _fused, asked, asked_vectors, at, recallable, register
from recallspark.plans.oracle_views import iso as sql_iso
from recallspark.sources import views
from recallspark.sources.views import iso, load, text_of
from recallspark.streaming import keyed

# storage and visibility


@register("drawers", "SELECT drawer_id, wing FROM drawers WHERE space_id = 'space_0' AND drawer_id > 20 ORDER BY drawer_id LIMIT 50")
def drawer_page(s, d):
    return storage.page(views.drawers(s, d), SPACE, 50, 20).select("drawer_id", "wing")


@register("drawers", "SELECT drawer_id, room FROM drawers WHERE drawer_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def drawer_multi_get(s, d):
    return storage.get_many(views.drawers(s, d), load(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("drawer_id"))).select("drawer_id", "room")


@register("drawers", "SELECT space_id, source_turn_id, min(drawer_id) AS drawer_id FROM drawers WHERE source_turn_id IN (SELECT 'turn_' || (conv_id % 500) FROM conversations) GROUP BY 1, 2")
def drawer_by_source_turn(s, d):
    turns = load(s, d, "conversations").select(text_of("turn_", F.col("conv_id") % 500).alias("source_turn_id"))
    return storage.by_source_turn(views.drawers(s, d), turns).select("space_id", "source_turn_id", "drawer_id")


@register("drawers", "SELECT drawer_id, (SELECT count(*) > 100 FROM drawers) AS capped FROM drawers ORDER BY drawer_id LIMIT 100")
def drawer_scan_capped(s, d):
    return storage.capped(views.drawers(s, d), 100).select("drawer_id", "capped")


@register("", """SELECT conv_id, turn, 'drawer_Wing_Event_' || role || '_' || substr(sha256('Wing_Event' || role || text), 1, 24) AS drawer_key, '2024-01-01T00:00:00.000000Z' AS indexed_at, coalesce(CASE WHEN turn % 2 = 0 THEN '2023-05-0' || (turn % 9 + 1) END, '2024-01-01T00:00:00.000000Z') AS occurred_at,
 CASE WHEN turn % 2 = 0 THEN 4 ELSE 3 END AS fields FROM conversations""")
def drawer_shape(s, d):
    when = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("2023-05-0"), (F.col("turn") % 9 + 1).cast("string")))
    rows = load(s, d, "conversations").select("conv_id", "turn", F.lit("Wing_Event").alias("wing"), F.col("role").alias("room"), "text", F.create_map(F.lit("occurred_at"), when, F.lit("memory_time"), when, F.lit("note"), F.lit(None).cast("string")).alias("metadata"))
    out = storage.shaped(rows, graph.time("2024-01-01T00:00:00"))
    return out.select("conv_id", "turn", "drawer_key", F.col("shaped")["indexed_at"].alias("indexed_at"), F.col("shaped")["occurred_at"].alias("occurred_at"), F.size("shaped").alias("fields"))


@register("drawers", "SELECT 'c_' || substr(sha256(text), 1, 24) AS key, min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 60 AND text IS NOT NULL) GROUP BY 1")
def drawer_upsert_fresh(s, d):
    rows = load(s, d, "documents").select("doc_id", F.concat(F.lit("c_"), F.substring(F.sha2("text", 256), 1, 24)).alias("key")).where("key is not null")
    return storage.fresh(rows, rows.where("doc_id < 60"), "key", ["doc_id"]).select("key", "doc_id")


@register("", """SELECT seq, kind, turn_id, error FROM (SELECT event_id AS seq, CASE event_id % 5 WHEN 1 THEN NULL WHEN 2 THEN 'other' WHEN 4 THEN 'memory_command' ELSE 'conversation_turn' END AS kind, CASE event_id % 5 WHEN 0 THEN 'turn_' || event_id WHEN 3 THEN '' END AS turn_id,
 CASE event_id % 5 WHEN 1 THEN 'unreadable' WHEN 2 THEN 'unknown kind' WHEN 3 THEN 'turn without id' END AS error FROM events)""")
def envelope_parse(s, d):
    n, turn = F.col("event_id"), F.when(F.col("event_id") % 5 == 3, F.lit("")).otherwise(text_of("turn_", F.col("event_id")))
    kind = F.when(n % 5 == 2, F.lit("other")).when(n % 5 == 4, F.lit("memory_command")).otherwise(F.lit("conversation_turn"))
    value = F.when(n % 5 == 1, F.lit("{broken")).otherwise(F.to_json(F.struct(F.lit("1").alias("schema_version"), kind.alias("kind"), F.to_json(F.struct(turn.alias("turn_id"), F.lit("x").alias("user_text"))).alias("payload"))))
    return storage.unwrapped(load(s, d, "events").select(n.alias("seq"), value.alias("value"))).select("seq", "kind", F.col("turn.turn_id").alias("turn_id"), "error")


@register("", """SELECT event_id FROM (SELECT *, count(*) OVER w AS n, sum(strlen(props)) OVER w AS b FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 14 DAY WINDOW w AS (PARTITION BY user_id % 4 ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE n <= 300 AND b <= 6000""")
def stream_retention(s, d):
    rows = load(s, d, "events").select("event_id", text_of("space_", F.col("user_id") % 4).alias("space_id"), F.col("event_id").alias("seq"), "ts", F.octet_length("props").alias("bytes"))
    return storage.retained(rows, graph.time("2024-01-30T00:00:00"), 14, 300, 6000).select("event_id")


@register("", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("benchmark", "conversations", "documents", "events", "labels", "pages")))
def palace_inventory(s, d):
    return storage.inventory({t: load(s, d, t) for t in ("benchmark", "conversations", "documents", "events", "labels", "pages")})


_PARTS = {"nation": ["n_nationkey", "n_name"], "region": ["r_regionkey", "r_name"], "conversations": ["conv_id", "turn", "role"]}


_HASHED = "sha256(concat_ws('|', {}))"
_DIGEST = "SELECT '{0}' AS \"table\", count(*) AS rows, sum(('0x' || substr(h, 1, 16))::UBIGINT)::VARCHAR || '-' || sum(('0x' || substr(h, 17, 16))::UBIGINT)::VARCHAR AS digest FROM (SELECT {1} AS h FROM {0})"


def _row_hash(columns: list[str]) -> str:
    return _HASHED.format(", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE length({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in columns))


@register("", " UNION ALL ".join(_DIGEST.format(t, _row_hash(c)) for t, c in sorted(_PARTS.items())))
def snapshot_manifest(s, d):
    return storage.manifest({t: (load(s, d, t), c) for t, c in _PARTS.items()})


@register("", "SELECT 'nation' AS \"table\", 'changed' AS fault UNION ALL SELECT 'region', 'missing'")
def snapshot_faults(s, d):
    tables = {t: (load(s, d, t), c) for t, c in _PARTS.items()}
    held = {"nation": (tables["nation"][0].where("n_nationkey <> 3"), _PARTS["nation"]), "conversations": tables["conversations"]}
    return storage.manifest_faults(storage.manifest(tables), storage.manifest(held))


_DEVICE = "(coalesce(visibility, '') <> 'current_device' OR source_device_id = 'device_2' OR target_device_id = 'device_2')"


@register("drawers", f"SELECT drawer_id FROM drawers WHERE wing IN ('Wing_Work', 'Wing_Life', 'Wing_Profile') AND coalesce(audience, 'owner') IN ('owner', 'companion:c0') AND {_DEVICE} AND layer = 'personal'")
def search_prefilter(s, d):
    return views.drawers(s, d).where(visibility.stored(["Wing_Work", "Wing_Life", "Wing_Profile"], None, READERS, "device_2", ["personal"])).select("drawer_id")


@register("visible_drawers", "SELECT drawer_id FROM visible_drawers WHERE scope <> 'device' OR 'device_2' IN (source_device_id, target_device_id)")
def rendered_drawers(s, d):
    return views.drawers(s, d).where(visibility.rendered(CALLER)).select("drawer_id")


@register("drawers", "SELECT drawer_id, wing <> 'Wing_Privacy' AND privacy NOT IN ('private', 'do_not_recall') AND coalesce(lower(room_status), '') NOT IN ('taboo', 'archived') AS recallable, wing <> 'Wing_Privacy' AS listed FROM drawers")
def storage_policy(s, d):
    return views.drawers(s, d).select("drawer_id", visibility.recallable().alias("recallable"), visibility.listed().alias("listed"))


_ONTOLOGY = "(VALUES " + ", ".join(f"('{p}', '{w}', '{k}')" for (w, k), ps in ontology.WINGS.items() for p in ps) + ") o(p, ow, ot)"


@register("claims", f"""SELECT idx, error, CASE WHEN error IS NULL THEN CASE WHEN triple THEN ow ELSE wing END END AS to_wing, CASE WHEN error IS NULL THEN CASE WHEN triple THEN ot ELSE memory_type END END AS to_type FROM (
 SELECT *, CASE WHEN triple AND ow IS NULL THEN 'unsupported predicate' WHEN triple AND wing NOT IN ('', 'auto') AND wing <> ow THEN 'wing conflicts' WHEN triple AND memory_type NOT IN ('', 'auto') AND memory_type <> ot THEN 'type conflicts' WHEN NOT triple AND (wing IN ('', 'auto') OR memory_type IN ('', 'auto')) THEN 'needs wing and type' END AS error FROM (
 SELECT *, predicate IS NOT NULL AS triple FROM (SELECT c.idx, CASE WHEN kind = 'invalidation' THEN replace(predicate, 'likes', 'adores') ELSE predicate END AS predicate, CASE importance WHEN 1 THEN 'Wing_Life' WHEN 2 THEN 'auto' WHEN 3 THEN 'Wing_Work' ELSE '' END AS wing, CASE WHEN confidence > 0.6 THEN 'life' WHEN confidence > 0.3 THEN '' ELSE 'work' END AS memory_type FROM claims c) LEFT JOIN {_ONTOLOGY} ON p = predicate))""")
def predicate_placement(s, d):
    """Where claims belong by what their predicates mean, against the wing and type that they ask for."""
    c = views.claims(s, d)
    rows = c.select("idx", "subject", F.when(F.col("kind") == "invalidation", F.replace("predicate", F.lit("likes"), F.lit("adores"))).otherwise(F.col("predicate")).alias("predicate"), "object",
        F.when(F.col("importance") == 1, "Wing_Life").when(F.col("importance") == 2, "auto").when(F.col("importance") == 3, "Wing_Work").otherwise("").alias("wing"), F.when(F.col("confidence") > 0.6, "life").when(F.col("confidence") > 0.3, "").otherwise("work").alias("memory_type"))
    return ontology.placed(rows).select("idx", "error", "to_wing", "to_type")


@register("claims", f"""SELECT idx, CASE WHEN p IS NULL THEN 'unknown predicate' END AS fault FROM claims LEFT JOIN {_ONTOLOGY} ON p = predicate""")
def predicate_whitelist(s, d):
    known = ontology.registry(s).select("predicate", F.lit(True).alias("known"))
    return views.claims(s, d).join(F.broadcast(known), "predicate", "left").select("idx", F.when(F.col("known").isNull(), F.lit("unknown predicate")).alias("fault"))


@register("drawers visible_drawers", f"""SELECT place, wing, room, drawers, titles, drawers > 3 AS more, (SELECT count(*) FROM s WHERE seen) AS entry_count, (SELECT count(*) FROM s WHERE NOT seen) AS withheld_count, (SELECT count(*) > 800 FROM drawers) AS truncated FROM (
 SELECT coalesce(nullif(list_position({views.WINGS[:5]!r}, wing), 0), 6)::INT AS place, wing, room, count(*) AS drawers, array_to_string(list_sort(list(drawer_id))[1:3], ',') AS titles FROM s WHERE seen GROUP BY ALL)""".replace("SELECT place", ", s AS (SELECT *, drawer_id IN (SELECT drawer_id FROM visible_drawers) AS seen FROM (SELECT * FROM drawers ORDER BY drawer_id LIMIT 800)) SELECT place", 1))
def owner_tree(s, d):
    """What the owner's browser shows of the first 800 records: wings in order, rooms, titles, and how many are withheld."""
    return browse.owner_tree(views.drawers(s, d), visibility.visible(CALLER), views.WINGS[:5], 3, 800).withColumn("titles", F.array_join("titles", ","))


@register("drawers", "SELECT space_id, drawer_id, wing FROM drawers WHERE wing NOT IN ('Wing_Privacy', 'Wing_Theme')")
def searched_wings(s, d):
    return views.drawers(s, d).where(F.col("wing").isin(visibility.searched_wings(None, views.WINGS))).select("space_id", "drawer_id", "wing")


# wording


_LABEL = "CASE WHEN {0} = 'self' THEN '用户' WHEN contains({0}, ':') THEN substr({0}, instr({0}, ':') + 1) ELSE {0} END"
_SENTENCE = "CASE predicate " + " ".join(f"WHEN '{p}' THEN replace(replace('{text.TEMPLATES[p]}', '{{s}}', s), '{{o}}', o)" for p in ("likes", "uses", "owns", "works_at", "has_symptom")) + " ELSE s || ' ' || predicate || ' ' || o END"
_WHEN = "CASE WHEN {0} IS NULL THEN '' WHEN strftime({0}, '%H:%M:%S') = '00:00:00' THEN strftime({0}, '%Y-%m-%d') ELSE strftime({0}, '%Y-%m-%d %H:%M') END"
_LINE = f"""'（推测）' || {_SENTENCE} || CASE WHEN len(parts) > 0 THEN '（' || array_to_string(parts, '；') || '）' ELSE '' END"""
_LINES = f"""(SELECT *, [x FOR x IN [CASE WHEN t <> '' THEN CASE WHEN b <> '' THEN b ELSE '？' END || ' → ' || t || '，已结束' WHEN b <> '' THEN '自 ' || b END,
 CASE WHEN strftime(recorded_at, '%Y-%m') <> substr(b, 1, 7) THEN '根据 ' || strftime(recorded_at, '%Y-%m') || ' 的对话' END] IF x IS NOT NULL] AS parts FROM (
 SELECT *, {_LABEL.format('subject_id')} AS s, {_LABEL.format('object_id')} AS o, {_WHEN.format('valid_from')} AS b, {_WHEN.format('valid_to')} AS t FROM {{}}))"""


def _line() -> F.Column:
    return text.transcribed(F.col("subject_id"), F.col("predicate"), F.col("object_id"), F.col("valid_from"), F.col("valid_to"), F.col("recorded_at"))


@register("statements", f"SELECT statement_id, {_LINE} AS line FROM {_LINES.format('statements')}")
def fact_lines(s, d):
    return views.statements(s, d).select("statement_id", _line().alias("line"))


# the graph half of recalls


_ENDED = "SELECT *, unnest(CASE WHEN subject_id = object_id THEN [subject_id] ELSE [subject_id, object_id] END) AS entity_id FROM statements"


def _facts_sql(name: str, frontier: str) -> str:
    """The best statements about each entity of a frontier (query_id, space_id, name, ordinal)."""
    return f"""{name} AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY ordinal, erank) AS ordinal) FROM (
 SELECT f.query_id, f.ordinal, t.* FROM {frontier} f JOIN entities e ON e.space_id = f.space_id AND e.name = f.name JOIN best t ON t.space_id = e.space_id AND t.entity_id = e.entity_id
 QUALIFY row_number() OVER (PARTITION BY f.query_id, statement_id ORDER BY f.ordinal, erank) = 1))"""


def _recall_sql(recalled: str) -> str:
    """Statements of each query of `asking` (query_id, space_id, query) with its `hints` and recalled turns."""
    return f""", best AS (SELECT *, row_number() OVER (PARTITION BY space_id, entity_id ORDER BY {_ORDER}) AS erank FROM ({_ENDED} WHERE {_SEEN} AND {_VALID}) QUALIFY erank <= 8),
found AS (SELECT query_id, name, 0 AS stage, -length(name) AS short FROM asking JOIN entities USING (space_id) WHERE name <> '' AND contains(query, name)
 UNION ALL SELECT query_id, name, 1, -length(name) FROM asking JOIN entities USING (space_id) WHERE contains(name, ':') AND substr(name, instr(name, ':') + 1) <> '' AND contains(query, substr(name, instr(name, ':') + 1))
 UNION ALL SELECT query_id, name, 2, -length(alias) FROM asking JOIN mentions USING (space_id) JOIN entities USING (space_id, entity_id) WHERE audience IN ('owner', 'companion:c0') AND contains(lower(query), alias)),
matched AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY place, name) AS rank FROM (SELECT query_id, name, min((stage, short)) AS place FROM found GROUP BY 1, 2) QUALIFY rank <= 3),
led AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY place, name) AS ordinal FROM (SELECT query_id, name, min(place) AS place FROM hints GROUP BY 1, 2) QUALIFY ordinal <= 3),
seeds AS (SELECT query_id, space_id, name, ordinal FROM asking JOIN (SELECT * FROM led UNION ALL SELECT m.query_id, m.name, coalesce(n, 0) + rank FROM matched m LEFT JOIN (SELECT query_id, count(*) AS n FROM led GROUP BY 1) u USING (query_id)
 WHERE rank <= 3 - coalesce(n, 0) AND NOT EXISTS (SELECT 1 FROM led WHERE led.query_id = m.query_id AND led.name = m.name)) USING (query_id)),
recalled AS ({recalled}),
hops AS (SELECT query_id, space_id, name, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, name) AS ordinal FROM (SELECT DISTINCT query_id, space_id, source_turn_id FROM recalled) JOIN ({_ENDED} WHERE {_SEEN}) USING (space_id, source_turn_id) JOIN entities USING (space_id, entity_id) GROUP BY 1, 2, 3 QUALIFY ordinal <= 3),
{_facts_sql("primaries", "seeds")}, {_facts_sql("expanded", "hops")},
facts AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY restates, side, ordinal) AS ordinal) FROM (SELECT *, EXISTS (SELECT 1 FROM recalled r WHERE r.query_id = b.query_id AND r.source_turn_id = b.source_turn_id) AS restates FROM (
 SELECT *, 0 AS side FROM primaries UNION ALL SELECT *, 1 FROM expanded) b QUALIFY row_number() OVER (PARTITION BY query_id, statement_id ORDER BY side, ordinal) = 1) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY restates, side, ordinal) <= 24)
"""


_ASKING = ", asking AS (SELECT query_id, 'space_0' AS space_id, query FROM queries), hints AS (SELECT query_id, 'user:' || (4 * (query_id % 30)) AS name, 1 AS place FROM queries WHERE query_id % 2 = 0 UNION ALL SELECT query_id, 'item:' || (query_id % 100), 2 FROM queries WHERE query_id % 4 = 0)"
_RECALLED = _ASKING + _recall_sql("SELECT query_id, space_id, source_turn_id FROM placed JOIN (SELECT drawer_id, space_id, source_turn_id FROM visible_drawers) v USING (drawer_id)")
_FACT_LINES = f"said AS (SELECT query_id, string_agg('- ' || {_LINE}, chr(10) ORDER BY ordinal) AS said FROM {_LINES.format('facts')} GROUP BY 1)"


def _with_facts_sql(rows: str) -> str:
    return f", {_FACT_LINES}, shown AS ({_RENDERED.format(rows)}) SELECT query_id, array_to_string([x FOR x IN [said, context] IF x IS NOT NULL], chr(10) || chr(10)) AS context FROM said FULL JOIN shown USING (query_id)"


def _hints(s, d) -> DataFrame:
    """What callers name beside their query: a user for every second one, an item besides for every fourth."""
    q = asked(s, d)
    n = F.col("query_id")
    return q.where(n % 2 == 0).select(n, text_of("user:", 4 * (n % 30)).alias("name"), F.lit(1).alias("place")).unionByName(q.where(n % 4 == 0).select(n, text_of("item:", n % 100).alias("name"), F.lit(2).alias("place")))


def _recall_facts(s, d, records: DataFrame) -> DataFrame:
    """Each query's own statements; records: its recalled drawers."""
    queries = asked(s, d).select("query_id", F.lit(SPACE).alias("space_id"), "query")
    turns = written(records.select("query_id", "drawer_id").join(recallable(s, d).select("drawer_id", "space_id", "source_turn_id"), "drawer_id"), "turns")
    return graph_recall.recall(queries, _hints(s, d), turns, views.statements(s, d), views.entities(s, d), views.mentions(s, d), READERS, at())


@register("placed queries statements entities mentions visible_drawers", _RECALLED + "SELECT query_id, ordinal, statement_id, restates FROM facts")
def recall_facts(s, d):
    """Facts of every recall query: about what its hints and its text name, then one hop from the records it found."""
    return _recall_facts(s, d, retrieval.policy_rank(_fused(s, d), recallable(s, d), CALLER, 8)).select("query_id", "ordinal", "statement_id", "restates")


@register("statements entities mentions phrases", ", asking AS (SELECT phrase_id AS query_id, space_id, phrase AS query FROM phrases), hints AS (SELECT query_id, '' AS name, 0 AS place FROM asking WHERE false)" + _recall_sql("SELECT query_id, space_id, '' AS source_turn_id FROM asking WHERE false") + "SELECT query_id AS phrase_id, ordinal, statement_id FROM facts")
def phrase_facts(s, d):
    """Facts of everything that customers say, about what each phrase names."""
    queries = views.phrases(s, d).withColumnsRenamed({"phrase_id": "query_id", "phrase": "query"})
    none = queries.where("false")
    found = graph_recall.recall(queries, none.select("query_id", F.lit("").alias("name"), F.lit(0).alias("place")), none.select("query_id", "space_id", F.lit("").alias("source_turn_id")), views.statements(s, d), views.entities(s, d), views.mentions(s, d), READERS, at())
    return found.select(F.col("query_id").alias("phrase_id"), "ordinal", "statement_id")


@register("statements drawers", "SELECT drawer_id, statement_id FROM drawers d JOIN statements s ON s.space_id = d.space_id WHERE s.subject_id IN ('user:0', 'user:1', 'user:4', 'user:5', 'user:8', 'user:9') AND memory_time IS NOT NULL AND (valid_from IS NULL OR valid_from <= memory_time) AND (valid_to IS NULL OR valid_to > memory_time)")
def facts_when_told(s, d):
    """The statements about some users that held when each memory was told: an as-of join of two tables."""
    known = views.statements(s, d).where(F.col("subject_id").isin("user:0", "user:1", "user:4", "user:5", "user:8", "user:9")).select("space_id", "statement_id", "valid_from", "valid_to")
    return graph_recall.valid_when(views.drawers(s, d).select("drawer_id", "space_id", "memory_time"), known, "memory_time", ["space_id"]).select("drawer_id", "statement_id")


@register("placed queries statements entities mentions visible_drawers", _RECALLED + _with_facts_sql("placed JOIN (SELECT drawer_id, wing, memory_type, memory_time, text FROM drawers) USING (drawer_id)"))
def rendered_with_facts(s, d):
    """The rendered memory of each query with its own facts above it."""
    rows = recallable(s, d)
    best = written(retrieval.policy_rank(_fused(s, d), rows, CALLER, 8), "records")
    said = _recall_facts(s, d, best).select("query_id", "ordinal", _line().alias("line"))
    return retrieval.render(best.join(rows.select(*_TEXTS), "drawer_id"), said)


@register("", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:20:30.000000Z' WHEN 2 THEN 'last spring' WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T10:20:30.500000Z' END AS t FROM orders""")
def canonical_times(s, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(k % 5 == 0, F.concat(F.lit(" "), day)).when(k % 5 == 1, F.concat(day, F.lit("T10:20:30Z"))).when(k % 5 == 2, F.lit("last spring")).when(k % 5 == 3, F.lit(" ")).otherwise(F.concat(day, F.lit("T12:20:30.5+02:00")))
    return load(s, d, "orders").select("o_orderkey", text.canonical_time(raw).alias("t"))


@register("", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'memory_time' WHEN 1 THEN 'valid_from' ELSE 'updated_at' END AS source, CASE o_orderkey % 3 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '2023-02-03' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
 o_orderkey % 2 = 0 AS modified, CASE WHEN o_orderkey % 4 = 0 THEN 'said' ELSE '' END AS quote FROM orders""")
def memory_times(s, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    at_, source = text.memory_time({"memory_time": F.when(k % 3 == 0, F.lit("2024-01-01")).otherwise(F.lit("soon")), "valid_from": F.when(k % 3 == 1, F.lit("2023-02-03")), "updated_at": day})
    meta = F.map_filter(F.create_map(F.lit("indexed_at"), F.lit("2024-01-05"), F.lit("last_modified"), F.when(k % 2 == 0, F.lit("2024-02-01")).otherwise(F.lit("2024-01-02")), F.lit("evidence_quote"), F.when(k % 4 == 0, F.lit("said"))), lambda _, v: v.isNotNull())
    known = text.provenance(meta)
    return load(s, d, "orders").select("o_orderkey", source.alias("source"), F.date_format(at_, "yyyy-MM-dd").alias("day"), known["last_modified_at"].isNotNull().alias("modified"), known["source_quote"].alias("quote"))


@register("", r"""SELECT conv_id, turn, 'topic_' || CASE WHEN t = '' THEN 'general' ELSE substr(t, 1, 48) END AS room, substr(sha256('space' || chr(10) || conv_id || chr(10) || turn || chr(10) || trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))), 1, 12) AS fragment
 FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '[^\p{L}\p{N}_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS t FROM conversations)""")
def room_tokens(s, d):
    return load(s, d, "conversations").select("conv_id", "turn", text.room_token(F.col("text")).alias("room"), F.substring(text.fragment_id(F.lit("space"), F.col("conv_id").cast("string"), F.col("turn"), F.col("text")), 1, 12).alias("fragment"))


@register("", "SELECT item_id, replace(lower(nfc_normalize(array_to_string([x FOR x IN string_split_regex(text, '\\s+') IF x <> ''], ' '))), 'ß', 'ss') AS folded FROM benchmark")
def folded_texts(s, d):
    return load(s, d, "benchmark").select("item_id", text.folded("text").alias("folded"))


@register("", """SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN e])), 6) AS norm, round(e[1], 6) AS first FROM (SELECT vec_id, [x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v] AS e FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL))""")
def unit_vectors(s, d):
    v = text.unit(F.col("embedding"))
    return load(s, d, "embeddings").where("embedding is not null").select("vec_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda z, x: z + x * x)), 6).alias("norm"), F.round(v[0], 6).alias("first"))


@register("", r"""SELECT item_id, k, round(x / norm, 6) AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY item_id)) AS norm FROM (SELECT item_id, ('0x' || substr(h, 1, 2))::INT % 16 AS k, sum(CASE WHEN ('0x' || substr(h, 3, 2))::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END * (1 + ('0x' || substr(h, 5, 2))::INT / 255.0::DOUBLE)) AS x
 FROM (SELECT item_id, sha256(unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS h FROM benchmark) GROUP BY 1, 2)) WHERE abs(x) > 1e-9""")
def hash_embeddings(s, d):
    rows = load(s, d, "benchmark").select("item_id", F.posexplode(text.hash_embedding(F.col("text"), 16)).alias("k", "x"))
    return rows.where("abs(x) > 1e-9").select("item_id", "k", F.round("x", 6).alias("x"))


@register("drawers", """SELECT drawer_id, drawer_id % 10 = 0 AS located, CASE WHEN drawer_id % 10 = 0 AND contains('andthe', 'and') THEN 0.12 ELSE 0 END::DOUBLE AS boost FROM drawers""")
def extension_boosts(s, d):
    found = text.extensions(F.col("extensions"))
    return views.drawers(s, d).select("drawer_id", F.map_contains_key(found, "location").alias("located"), text.boosts(found, F.lit("andthe")).alias("boost"))


@register("drawers", """SELECT drawer_id, 'b_' || room AS a, 2 AS tags, 2 AS kept, rtrim(translate(to_base64(('["' || room || '","' || drawer_id || '"]')::BLOB), '+/', '-_'), '=') AS cursor, 'b64_' || rtrim(translate(to_base64(space_id::BLOB), '+/', '-_'), '=') AS token FROM drawers""")
def record_wire(s, d):
    """Tags made clean, public metadata, page cursors (read back) and subject tokens of records."""
    made = text.cursor(F.col("room"), F.col("drawer_id"))
    meta = F.create_map(F.lit("room"), F.concat(F.lit("b_"), F.col("room")), F.lit("_distance"), F.lit("1"), F.lit("audience"), F.lit("x"), F.lit("wing"), F.col("wing"))
    tags = text.clean_list(F.array(F.lit(" b"), F.lit("a "), F.lit("b"), F.lit(" ")))
    rows = views.drawers(s, d).select("drawer_id", text.public_metadata(meta).alias("m"), F.size(tags).alias("tags"), made.alias("cursor"), text.cursor_parts(made).alias("back"), text.subject_token(F.col("space_id")).alias("token"), "room")
    return rows.where("back[0] = room and cast(back[1] as bigint) = drawer_id").select("drawer_id", F.col("m")["room"].alias("a"), "tags", F.size("m").alias("kept"), "cursor", "token")


@register("", """SELECT conv_id, turn, CASE WHEN role <> 'system' THEN '{"conv":' || conv_id || ',"turn":' || turn || ',"said":"' || substr(sha256(text), 1, 12) || '"}' END AS object FROM conversations""")
def reply_objects(s, d):
    """The object in what a model replies: a turn's text, a fenced object about it, and the text again; system turns have a brace that never closes."""
    about = F.to_json(F.struct(F.col("conv_id").alias("conv"), "turn", F.substring(F.sha2("text", 256), 1, 12).alias("said")))
    reply = F.when(F.col("role") != "system", F.concat("text", F.lit("\n```json\n"), about, F.lit("\n```\n"), "text")).otherwise(F.concat("text", F.lit(" {open")))
    return load(s, d, "conversations").select("conv_id", "turn", text.first_object(reply).alias("object"))


@register("", r"""SELECT doc_id, CASE WHEN length(safe) <= 40 THEN safe ELSE substr(safe, 1, 23) || '_' || substr(sha256(raw), 1, 16) END AS name FROM (SELECT doc_id, raw, CASE WHEN s = '' THEN 'default' ELSE s END AS safe FROM (
 SELECT doc_id, raw, regexp_replace(regexp_replace(raw, '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM (SELECT doc_id, trim(coalesce(text, '')) AS raw FROM documents)))""")
def safe_names(s, d):
    return load(s, d, "documents").select("doc_id", text.safe_name(F.col("text"), 40).alias("name"))


@register("", """SELECT label, k, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM (SELECT label, k, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE vec_id < 200 AND vec_id % 4 <> 0) GROUP BY 1, 2)""")
def pooled_vectors(s, d):
    """Vectors of a label pooled as tokens of one text, every fourth masked."""
    rows = load(s, d, "embeddings").where("vec_id < 200").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("e")))).alias("t"))
    v = text.pooled(F.transform("t", lambda t: t["e"]), F.transform("t", lambda t: (t["vec_id"] % 4 != 0).cast("int")))
    return rows.select("label", F.posexplode(v).alias("k", "x")).select("label", (F.col("k") + 1).alias("k"), F.round("x", 6).alias("x"))


# retrieval


@register("vector", """, near AS (SELECT query_id, drawer_id, text, similarity, rank FROM vector WHERE rank <= 10), w AS (SELECT query_id, drawer_id, rank, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_-]+|[^\\s\\p{Z}a-z0-9_-]') AS w FROM near),
n AS (SELECT query_id, count(*) AS n, avg(len(w)) AS mean FROM w GROUP BY 1), p AS (SELECT query_id, drawer_id, term, len(any_value(w)) AS size, count(*) AS tf FROM (SELECT *, unnest(w) AS term FROM w) GROUP BY 1, 2, 3),
df AS (SELECT query_id, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p JOIN n USING (query_id) GROUP BY query_id, term, n), f AS (SELECT query_id, 0.25 * avg(idf) AS floor FROM df GROUP BY 1),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(translate(query, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_-]+|[^\\s\\p{Z}a-z0-9_-]')) AS term FROM queries) GROUP BY 1, 2),
s AS (SELECT query_id, drawer_id, sum(times * CASE WHEN idf < 0 THEN floor ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) AS b FROM p JOIN q USING (query_id, term) JOIN df USING (query_id, term) JOIN f USING (query_id) JOIN n USING (query_id) GROUP BY 1, 2)
SELECT query_id, drawer_id, bm25, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0::DOUBLE / (59 + rank) + 1.0::DOUBLE / (59 + br), 9) DESC, rank) AS place FROM (
 SELECT query_id, drawer_id, rank, round(coalesce(b, 0), 6) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(b, 0), 6) DESC, rank) AS br FROM near LEFT JOIN s USING (query_id, drawer_id))) WHERE place <= 5""")
def window_rerank(s, d):
    rows = recallable(s, d)
    near = retrieval.vector_candidates(rows, asked_vectors(s, d), 10).join(rows.select("drawer_id", "text"), "drawer_id")
    return retrieval.rerank(retrieval.okapi_rank(near, asked(s, d)), 5).select("query_id", "drawer_id", "bm25", "place")


@register("fused visible_drawers", """SELECT query_id, drawer_id, score, place FROM (SELECT query_id, drawer_id, round(tier + boost, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(tier + boost, 6) DESC, rank) AS place FROM fused JOIN (SELECT drawer_id, CASE WHEN drawer_id % 10 = 0 THEN 0.12 ELSE 0 END AS boost,
 CASE WHEN scope = 'device' AND 'device_2' IN (source_device_id, target_device_id) THEN 0.9 WHEN scope IN ('global', 'persona') THEN 0.75 WHEN scope = 'agent' THEN 0.7 WHEN scope = 'device' THEN 0.25 ELSE 0.5 END::DOUBLE AS tier FROM visible_drawers) USING (drawer_id)) WHERE place <= 8""")
def policy_rank_boosted(s, d):
    boost = text.boosts(text.extensions(F.col("extensions")), F.lit("andthe"))
    return retrieval.policy_rank(_fused(s, d), recallable(s, d), CALLER, 8, boost).select("query_id", "drawer_id", F.col("tier").alias("score"), "place")


_THEMED = """, t AS (SELECT * FROM (SELECT query_id, drawer_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, drawer_id) AS rank FROM (
 SELECT query_id, drawer_id, round(list_cosine_similarity(embedding, v), 6) AS similarity FROM visible_drawers CROSS JOIN queries WHERE wing = 'Wing_Theme' AND embedding IS NOT NULL AND v IS NOT NULL)) WHERE rank <= 3 AND similarity >= 0.05),
themed AS (SELECT query_id, drawer_id, row_number() OVER (PARTITION BY query_id ORDER BY side, place, drawer_id) AS place FROM (SELECT query_id, drawer_id, rank AS place, 0 AS side FROM t UNION ALL SELECT query_id, drawer_id, place, 1 FROM placed p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.query_id = p.query_id AND t.drawer_id = p.drawer_id)))
"""


def _themed(s, d) -> DataFrame:
    """Themes that the caller may see, then fused records."""
    rows = recallable(s, d)
    themes = retrieval.theme_channel(rows, asked_vectors(s, d), floor=0.05)
    return retrieval.with_themes(themes, retrieval.policy_rank(_fused(s, d), rows, CALLER, 8))


@register("placed visible_drawers queries", _THEMED + "SELECT query_id, drawer_id, place FROM themed")
def theme_merge(s, d):
    return _themed(s, d).select("query_id", "drawer_id", "place")


@register("placed drawers queries statements entities mentions visible_drawers", _THEMED + _RECALLED + _with_facts_sql("themed JOIN (SELECT drawer_id, wing, memory_type, memory_time, text FROM drawers) USING (drawer_id)"))
def recall_context(s, d):
    """A whole recall in one plan: records by vector and words, fused and ranked, the themes that the caller may see before them, and each query's own facts above, as text."""
    rows = recallable(s, d)
    records = written(retrieval.policy_rank(_fused(s, d), rows, CALLER, 8), "records")
    themes = retrieval.theme_channel(rows, asked_vectors(s, d), floor=0.05)
    best = written(retrieval.with_themes(themes, records), "placed")
    said = written(_recall_facts(s, d, records).select("query_id", "ordinal", _line().alias("line")), "facts")
    return retrieval.render(best.join(rows.select(*_TEXTS), "drawer_id"), said)


@register("vector", "SELECT query_id, drawer_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, drawer_id) AS place FROM (SELECT query_id, drawer_id, round(coalesce(CASE WHEN drawer_id % 3 = 0 THEN similarity / 2 END, CASE WHEN drawer_id % 3 = 1 THEN similarity END, CASE WHEN drawer_id % 6 = 2 THEN 0.4::DOUBLE END, 0), 6) AS score FROM vector WHERE rank <= 12)) WHERE place <= 5")
def similarity_rank(s, d):
    n = F.col("drawer_id")
    near = retrieval.vector_candidates(recallable(s, d), asked_vectors(s, d), 12)
    rows = near.select("query_id", n, F.when(n % 3 == 0, F.col("similarity") / 2).alias("retrieval_score"), F.when(n % 3 == 1, F.col("similarity")).alias("similarity"), F.when(n % 6 == 2, F.lit(0.6)).alias("distance"))
    return retrieval.similarity_rank(rows, 5).select("query_id", "drawer_id", "score", "place")


@register("lexical", "SELECT query_id, drawer_id, score, rank FROM lexical WHERE rank <= 10")
def block_max_topk(s, d):
    """The best drawers by words, by postings in blocks that are skipped by their upper bounds."""
    return postings.search(postings.build(recallable(s, d)), asked(s, d), 10)[0].select("query_id", "drawer_id", "score", "rank")


_SEEING = ["wing", "space_id", "privacy", "layer", "visibility", "audience", "scope", "session_id", "person_id", "source_device_id", "target_device_id"]


def _indexed(s, d) -> vector_index.Index:
    return vector_index.build(views.drawers(s, d), _SEEING)


@register("vector", "SELECT query_id, drawer_id, similarity, rank FROM vector WHERE rank <= 10")
def vector_index_topk(s, d):
    """The nearest drawers by an index over all drawers; who may see them is a condition of its scan."""
    return vector_index.search(_indexed(s, d), asked_vectors(s, d), 10, visibility.visible(CALLER))[0].select("query_id", "drawer_id", "similarity", "rank")


@register("", None)
def vector_index_recall(s, d):
    """What the approximate search finds and reads for every query, reading as many cells as 0.9 of all hits need."""
    index, queries, seen = _indexed(s, d), asked_vectors(s, d), visibility.visible(CALLER)
    return vector_index.recall(index, queries, 10, vector_index.probes_for(index, queries, 10, 0.9, seen), seen)


@register("", """WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n, strftime(ts, '%Y-%m-%d') AS day, 'item:' || regexp_extract(props, '[0-9]+') AS item FROM events WHERE event_type = 'purchase' QUALIFY n <= 12),
a AS (SELECT user_id, arg_max(item, day || n) AS cur, arg_min(item, n) AS old FROM l GROUP BY 1), m AS (SELECT user_id, cur, old, max(day) FILTER (contains(item, cur)) AS newest FROM l JOIN a USING (user_id) GROUP BY ALL)
SELECT user_id AS query_id, coalesce(bool_and(day <= newest) FILTER (contains(item, old)), true) AS clean FROM l JOIN m USING (user_id) GROUP BY 1""")
def superseded_currency(s, d):
    """Whether what is told of each user's purchases presents the first of them as past, against the newest."""
    e = load(s, d, "events").where("event_type = 'purchase'").select("user_id", F.row_number().over(graph.Window.partitionBy("user_id").orderBy("value", "event_id")).alias("n"), F.date_format("ts", "yyyy-MM-dd").alias("day"), text_of("item:", F.regexp_extract("props", "[0-9]+", 0)).alias("item")).where("n <= 12")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("- ["), "day", F.lit("] "), "item").alias("line")))), lambda x: x["line"]), "\n")
    rows = e.groupBy(F.col("user_id").alias("query_id")).agg(lines.alias("context"), F.array(F.max_by("item", F.concat("day", F.col("n").cast("string")))).alias("expected"), F.array(F.min_by("item", "n")).alias("forbidden"))
    return retrieval.superseded_cleanly(rows)


@register("drawers", "SELECT room, drawers, tunnel FROM (SELECT room, count(*) AS drawers, count(DISTINCT wing) >= 2 AS tunnel FROM drawers GROUP BY room) ORDER BY tunnel DESC, drawers DESC, room NULLS LAST LIMIT 3")
def room_ranking(s, d):
    return browse.rooms(views.drawers(s, d)).orderBy(F.desc("tunnel"), F.desc("drawers"), F.asc_nulls_last("room")).limit(3).select("room", "drawers", "tunnel")


# steward


@register("claims", "SELECT idx, CASE WHEN trim(evidence_quote) = '' THEN 'missing' WHEN NOT contains(user_text, trim(evidence_quote)) THEN 'not verbatim' END AS fault FROM claims")
def steward_evidence(s, d):
    return steward.verbatim(views.claims(s, d)).select("idx", "fault")


@register("claims", """SELECT turn_id, count(*) AS proposed, count(*) FILTER (n > 6) AS cut, count(*) FILTER (n <= 6 AND importance < 3) AS dropped, count(*) FILTER (n <= 6 AND importance >= 3) AS written FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY idx) AS n FROM claims WHERE kind = 'fragment') GROUP BY 1""")
def steward_fragments(s, d):
    return steward.fragment_budget(views.claims(s, d).where("kind = 'fragment'"))


@register("claims", "SELECT idx, kind, CASE WHEN layer = 'household' THEN 'household' ELSE 'personal' END AS target FROM claims WHERE layer <> 'household' OR kind = 'fragment'")
def steward_layers(s, d):
    return steward.layer_split(views.claims(s, d)).select("idx", "kind", "target")


@register("claims statements", """SELECT idx, object FROM claims c WHERE kind <> 'triple' AND EXISTS (SELECT 1 FROM statements t WHERE t.source_turn_id = c.turn_id AND c.object IN (t.subject_id, t.object_id))""")
def steward_mention_guard(s, d):
    rows = views.claims(s, d).where("kind <> 'triple'").withColumn("entity_id", F.col("object"))
    return steward.guarded_mentions(rows, views.statements(s, d).withColumnRenamed("source_turn_id", "turn_id")).select("idx", "object")


_NARROW = "(scope <> 'persona' OR visibility <> 'all_devices' OR target_device_id <> '')"


@register("claims", f"""SELECT idx, CASE WHEN t THEN 'fragment' WHEN reason IS NOT NULL THEN 'reject' ELSE 'triple' END AS becomes, reason, CASE WHEN NOT t AND reason IS NULL THEN least(confidence, fact_confidence) ELSE confidence END AS sure, {sql_iso('coalesce(valid_from, occurred_at)')} AS starts FROM (
 SELECT *, CASE WHEN NOT t AND {_NARROW} THEN 'restricted scope' WHEN NOT t AND privacy = 'sensitive' AND predicate <> 'has_symptom' THEN 'sensitive claim' END AS reason FROM (SELECT *, predicate IS NULL OR layer = 'household' AS t FROM claims))""")
def steward_split(s, d):
    return steward.split_claims(views.claims(s, d)).select("idx", "becomes", "reason", "sure", iso(F.col("starts")).alias("starts"))


@register("claims", """SELECT idx, 'intent:' || substr(sha256(space_id || '|' || turn_id || '|' || kind || '|' || idx || '|' || claim), 1, 32) AS intent_id, CASE kind WHEN 'fragment' THEN 'fact' WHEN 'triple' THEN CASE WHEN predicate = 'likes' THEN 'preference' ELSE 'fact' END WHEN 'invalidation' THEN 'correction' ELSE 'forget' END AS intent_type,
 CASE WHEN kind IN ('fragment', 'triple') THEN 'add' ELSE 'invalidate' END AS operation, CASE kind WHEN 'fragment' THEN '$text' WHEN 'privacy' THEN NULL ELSE subject END AS subject, CASE kind WHEN 'fragment' THEN content WHEN 'privacy' THEN NULL ELSE object END AS object, CASE WHEN kind IN ('fragment', 'triple') THEN confidence ELSE 1.0 END AS confidence
 FROM (SELECT *, CASE kind WHEN 'fragment' THEN content WHEN 'triple' THEN content WHEN 'invalidation' THEN 'invalidate ' || concat_ws(' ', subject, predicate, object) ELSE concat_ws(': ', predicate, content) END AS claim FROM claims)""")
def steward_intents(s, d):
    return steward.intents(views.claims(s, d)).select("idx", "intent_id", "intent_type", "operation", "subject", "object", "confidence")


@register("claims turn_contexts", """SELECT idx, t.space_id, audience, device_id AS source_device_id, CASE WHEN privacy = 'private' AND audience <> 'owner' THEN 'normal' ELSE privacy END AS privacy, CASE WHEN scope = 'device' AND target_device_id = '' THEN device_id ELSE target_device_id END AS target_device_id FROM claims c JOIN turn_contexts t USING (turn_id)""")
def steward_identity(s, d):
    contexts = views.turn_contexts(s, d)
    return steward.stamped(views.claims(s, d).join(contexts.select("turn_id"), "turn_id", "left_semi"), contexts).select("idx", "space_id", "audience", "source_device_id", "privacy", "target_device_id")


@register("turn_contexts", "SELECT turn_id, CASE WHEN space_id <> 'space_0' THEN 'skip' WHEN layer <> 'personal' OR person_id IS NULL THEN 'dead' ELSE 'process' END AS route FROM turn_contexts")
def turn_routes(s, d):
    return steward.routed(views.turn_contexts(s, d), SPACE, "personal").select("turn_id", "route")


# the canonical ledger


@register("canonical", f"SELECT * EXCLUDE (updated_at), {sql_iso('updated_at')} AS updated_at, CASE WHEN activations <= 1 THEN fact_id ELSE fact_id || ':activation:' || activations END AS projection_id FROM canonical")
def canonical_fold(s, d):
    return canonical.fold(views.canonical_events(s, d)).withColumn("updated_at", iso(F.col("updated_at")))


_SUMS = ", ".join([*(f"sum({c})::BIGINT AS {c}_total" for c in ("evidence", "invalidations", "supersessions", "reactivations")), *(f"sum({c})::BIGINT AS {c}" for c in ("reactivations_pending", "invalidations_pending", "supersessions_pending"))])


@register("canonical", f"""SELECT count(*) AS assertions_total, {', '.join(f"count(*) FILTER (state = '{x}') AS assertions_{x}" for x in ('active', 'invalidated', 'superseded', 'forgotten'))}, {_SUMS},
 count(*) FILTER (state = 'forgotten' AND drawer = 'pending') + count(*) FILTER (state = 'forgotten' AND kg = 'pending') AS forget_projections_pending, count(*) FILTER (state = 'active' AND drawer = 'pending') AS drawer_not_projected, count(*) FILTER (state = 'active' AND drawer = 'projected') AS drawer_projected,
 count(*) FILTER (state = 'active' AND kg = 'pending') AS kg_not_projected, count(*) FILTER (state = 'active' AND kg = 'projected') AS kg_projected, {sql_iso("max(updated_at) FILTER (drawer <> 'pending' AND kg <> 'pending')")} AS last_materialized_at FROM canonical""")
def canonical_ledger_stats(s, d):
    out = canonical.stats(canonical.fold(views.canonical_events(s, d)))
    return out.withColumn("last_materialized_at", iso(F.col("last_materialized_at")))


@register("canonical_events", """SELECT slot, fact_id, seq, n, facts_capped, events_capped FROM (SELECT *, row_number() OVER (PARTITION BY slot, fact_id ORDER BY seq) AS n FROM (SELECT e.*, fc > 3 AS facts_capped, ec > 4 AS events_capped FROM canonical_events e JOIN (
 SELECT *, row_number() OVER (PARTITION BY slot ORDER BY last DESC, fact_id) AS place, count(*) OVER (PARTITION BY slot) AS fc FROM (SELECT slot, fact_id, max(seq) AS last, count(*) AS ec FROM canonical_events GROUP BY 1, 2)) f USING (slot, fact_id) WHERE place <= 3
 QUALIFY row_number() OVER (PARTITION BY slot, fact_id ORDER BY seq DESC) <= 4))""")
def canonical_history(s, d):
    return canonical.history(views.canonical_events(s, d), 3, 4).select("slot", "fact_id", "seq", "n", "facts_capped", "events_capped")


@register("canonical_events", "SELECT DISTINCT fact_id, source FROM canonical_events WHERE kind IN ('add', 'invalidate', 'reactivate') AND fact_id IN (SELECT fact_id FROM canonical_events WHERE kind = 'forget' AND result = 'hard')")
def canonical_forget_sources(s, d):
    return canonical.sources_of_forgotten(views.canonical_events(s, d))


@register("canonical_events", "SELECT seq, fact_id, kind FROM canonical_events WHERE kind = 'forget' OR fact_id NOT IN (SELECT fact_id FROM canonical_events WHERE kind = 'forget' AND result = 'hard')")
def canonical_scrub(s, d):
    return canonical.scrubbed(views.canonical_events(s, d)).select("seq", "fact_id", "kind")


@register("canonical statements drawers", """, a AS (SELECT DISTINCT space_id, subject_id, predicate, object_id, audience, 'fact_' || substr(subject_id, 6) || '_0' AS fact_id FROM statements WHERE predicate = 'owns'),
h AS (SELECT a.*, statement_id, source_turn_id FROM a LEFT JOIN (SELECT * FROM statements WHERE valid_to IS NULL) s USING (space_id, subject_id, predicate, object_id, audience))
SELECT a.space_id, a.subject_id, a.object_id, a.audience, (SELECT count(DISTINCT statement_id) FROM h WHERE (h.space_id, h.subject_id, h.object_id, h.audience) = (a.space_id, a.subject_id, a.object_id, a.audience)) AS statements,
 coalesce((SELECT count(*) FROM drawers d JOIN (SELECT DISTINCT source_turn_id FROM h WHERE (h.space_id, h.subject_id, h.object_id, h.audience) = (a.space_id, a.subject_id, a.object_id, a.audience)) t USING (source_turn_id) WHERE d.space_id = a.space_id), 0) AS drawers, (SELECT count(*) FROM canonical c WHERE c.fact_id = a.fact_id AND state = 'active') AS facts FROM a""")
def canonical_exact_invalidation(s, d):
    rows = views.statements(s, d)
    key = ["space_id", "subject_id", "predicate", "object_id", "audience"]
    asks = rows.where("predicate = 'owns'").select(*key).distinct().withColumn("fact_id", F.concat(F.lit("fact_"), F.substring("subject_id", 6, 100), F.lit("_0")))
    return canonical.exact_invalidation(asks, rows, views.drawers(s, d), canonical.fold(views.canonical_events(s, d))).select("space_id", "subject_id", "object_id", "audience", "statements", "drawers", "facts")


def _slots(s, d) -> DataFrame:
    """Facts as values of slots: a slot's object is the last digit of the fact."""
    return canonical.fold(views.canonical_events(s, d)).select("slot", F.split_part("fact_id", F.lit("_"), F.lit(3)).alias("object"), "state")


@register("canonical", """, v AS (SELECT slot, split_part(fact_id, '_', 3) AS object, state FROM canonical), a AS (SELECT DISTINCT 'slot_' || user_id AS slot, (['lives_in', 'born_in', 'likes'])[event_id % 3 + 1] AS predicate, CAST(event_id % 12 AS VARCHAR) AS object FROM events WHERE event_id % 4 = 0)
SELECT a.slot, predicate, a.object, CASE WHEN act THEN 'noop' WHEN ina AND predicate = 'likes' THEN 'reactivate' WHEN ina AND n = 0 THEN 'reactivate' WHEN ina AND predicate = 'lives_in' AND n = 1 THEN 'supersede and reactivate' WHEN NOT ina AND predicate = 'lives_in' AND n = 1 THEN 'supersede' WHEN NOT ina AND predicate = 'lives_in' AND n = 0 THEN 'add' ELSE 'reject' END AS plan FROM (
 SELECT a.*, coalesce((SELECT bool_or(state = 'active') FROM v WHERE v.slot = a.slot AND v.object = a.object), false) AS act, coalesce((SELECT bool_or(state IN ('invalidated', 'superseded')) FROM v WHERE v.slot = a.slot AND v.object = a.object), false) AS ina, (SELECT count(*) FROM v WHERE v.slot = a.slot AND state = 'active') AS n FROM a) a""")
def update_plans(s, d):
    n = F.col("event_id")
    asks = load(s, d, "events").where(n % 4 == 0).select(text_of("slot_", F.col("user_id")).alias("slot"), views.choose(n % 3, ["lives_in", "born_in", "likes"]).alias("predicate"), (n % 12).cast("string").alias("object")).distinct()
    return steward.plan_updates(asks, _slots(s, d)).select("slot", "predicate", "object", "plan")


_OPS = "(['claim', 'finish', 'fail', 'resolve', 'claim', 'release'])[event_id % 6 + 1]"
_DLQ_STEP = "CASE WHEN op = 'claim' AND state = 'unresolved' THEN 'replaying' WHEN op = 'finish' AND state = 'replaying' THEN 'replayed' WHEN op IN ('fail', 'release') AND state = 'replaying' THEN 'unresolved' WHEN op = 'resolve' AND state <> 'replaying' THEN 'resolved' END"


@register("", f"""WITH RECURSIVE o AS (SELECT event_id % 700 AS entry_id, {_OPS} AS op, row_number() OVER (PARTITION BY event_id % 700 ORDER BY event_id) AS n FROM events),
f AS (SELECT DISTINCT entry_id, 0::BIGINT AS n, 'unresolved' AS state, 0 AS attempts, 0 AS rejected FROM o UNION ALL SELECT f.entry_id, o.n, coalesce({_DLQ_STEP}, state), attempts + (op = 'claim' AND state = 'unresolved')::INT, rejected + (({_DLQ_STEP}) IS NULL)::INT FROM f JOIN o ON o.entry_id = f.entry_id AND o.n = f.n + 1)
SELECT entry_id, state, attempts, rejected FROM f QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY n DESC) = 1""")
def dlq_fold(s, d):
    n = F.col("event_id")
    ops = load(s, d, "events").select((n % 700).alias("entry_id"), n.alias("seq"), views.choose(n % 6, ["claim", "finish", "fail", "resolve", "claim", "release"]).alias("op"))
    return ledgers.fold_dead_letters(ops)


@register("command_events", """, m AS (SELECT request_id, min(seq) FILTER (status = 'applied') AS a, min(seq) FILTER (status = 'failed') AS f FROM command_events GROUP BY 1),
c AS (SELECT e.request_id, CASE WHEN any_value(a) IS NOT NULL THEN 'applied' WHEN any_value(f) IS NOT NULL THEN 'failed' ELSE coalesce(arg_max(e.status, seq) FILTER (status <> 'accepted'), 'accepted') END AS status, count(*) FILTER (status <> 'accepted' AND (coalesce(least(a, f), a, f) IS NULL OR seq <= coalesce(least(a, f), a, f) OR seq = a)) AS attempts FROM command_events e JOIN m USING (request_id) GROUP BY 1)
SELECT status, count(*) AS requests, sum(attempts)::BIGINT AS attempts, max(attempts) AS most FROM c GROUP BY 1""")
def command_stats(s, d):
    return ledgers.command_stats(ledgers.command_status(views.command_events(s, d)))


@register("drawers", "SELECT space_id, count(*) AS rows, sum(strlen(text))::BIGINT AS bytes, count(*) < 450 AND sum(strlen(text)) < 1500000 AS admits FROM drawers GROUP BY 1")
def provisional_capacity(s, d):
    return ledgers.capacity(views.drawers(s, d).select("space_id", F.octet_length("text").alias("bytes")), 450, 1_500_000)


_PROMISES = "c AS (SELECT o_orderkey AS commitment_id, count(*) AS revision FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"


def _revisions(s, d) -> DataFrame:
    return views.commitment_events(s, d).groupBy("commitment_id").agg(F.count("*").alias("revision"))


@register("", f"WITH {_PROMISES} SELECT commitment_id, revision, commitment_id % 3 <> 0 AND revision > 1 AS projected FROM c")
def commitment_projection(s, d):
    rows = _revisions(s, d)
    marks = rows.where("commitment_id % 3 <> 0").select("commitment_id", F.when(F.col("revision") > 1, F.col("revision")).otherwise(F.lit(0)).alias("revision"))
    return ledgers.projected_commitments(rows, marks.unionByName(rows.select("commitment_id", (F.col("revision") - 1).alias("revision"))))


@register("", f"WITH {_PROMISES} SELECT commitment_id FROM c WHERE commitment_id % 5 <> 0 OR commitment_id % 2 = 0")
def commitment_unarchived(s, d):
    rows = _revisions(s, d)
    stones = rows.where("commitment_id % 5 = 0").select("commitment_id", F.when(F.col("commitment_id") % 2 == 0, F.lit("archived")).otherwise(F.lit("forgotten")).alias("state"))
    return ledgers.unarchived(rows, stones).select("commitment_id")


@register("", "SELECT DISTINCT l_orderkey AS commitment_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 7 = 0")
def commitments_of_sources(s, d):
    events = views.commitment_events(s, d)
    revisions = events.select("commitment_id", F.col("participant").alias("source"))
    sources = load(s, d, "supplier").where("s_suppkey % 7 = 0").select(text_of("supplier:", F.col("s_suppkey")).alias("source"))
    return ledgers.commitments_of_sources(revisions, _revisions(s, d), sources).select("commitment_id")


@register("drawers", """, c AS (SELECT DISTINCT l.source_turn_id AS target, CASE WHEN toxic = 1 THEN 'delete' ELSE 'archive_topic' END AS action, d.drawer_id FROM labels JOIN drawers l ON l.drawer_id = doc_id JOIN drawers d ON d.source_turn_id = l.source_turn_id WHERE toxic = 1 OR quality = 0),
o AS (SELECT *, action = 'delete' AND count(*) OVER (PARTITION BY target, action) = 1 AS erases FROM c)
SELECT target, action, drawer_id, CASE WHEN alone THEN 'erase' ELSE 'archive' END AS outcome, action = 'delete' AND NOT alone AS downgraded FROM (SELECT *, bool_and(erases) OVER (PARTITION BY drawer_id) AS alone FROM o)""")
def privacy_outcomes(s, d):
    """What becomes of the drawers of turns that labels call toxic (to be deleted) or poor (to be archived)."""
    rows = views.drawers(s, d).select("drawer_id", "source_turn_id")
    asks = load(s, d, "labels").where("toxic = 1 or quality = 0").select(F.col("doc_id").alias("drawer_id"), F.when(F.col("toxic") == 1, F.lit("delete")).otherwise(F.lit("archive_topic")).alias("action"))
    asks = asks.join(rows, "drawer_id").select(F.col("source_turn_id").alias("target"), "action").distinct()
    return erasure.privacy_outcomes(asks.join(rows.withColumnRenamed("source_turn_id", "target"), "target"))


_LOG = "SELECT 'space_' || (user_id % 4) AS space_id, 'user:' || user_id AS subject_id, 'likes' AS predicate, 'item:' || (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 4) AS object_id, 'owner' AS audience, event_id AS seq, CASE WHEN event_type IN ('purchase', 'error') THEN 'invalidate' ELSE 'add' END AS op, 'stmt_' || event_id AS statement_id, 'turn_' || (event_id % 20) AS turn_id, ts AS told_at FROM events"


@register("", f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY subject_id, object_id ORDER BY seq) AS n FROM ({_LOG})),
f AS (SELECT space_id, subject_id, predicate, object_id, audience, 0::BIGINT AS n, NULL::VARCHAR AS open, []::VARCHAR[] AS turns, NULL::VARCHAR AS starts, NULL::TIMESTAMP AS begun, NULL::VARCHAR AS ends, NULL::TIMESTAMP AS closed FROM l WHERE n = 1
 UNION ALL SELECT f.space_id, f.subject_id, f.predicate, f.object_id, f.audience, l.n, CASE WHEN op = 'invalidate' THEN NULL WHEN open IS NULL AND NOT list_contains(turns, turn_id) THEN statement_id ELSE open END,
  CASE WHEN op = 'add' AND open IS NULL THEN list_distinct(list_append(turns, turn_id)) ELSE turns END, CASE WHEN op = 'add' AND open IS NULL AND NOT list_contains(turns, turn_id) THEN statement_id END, told_at, CASE WHEN op = 'invalidate' THEN open END, told_at
 FROM f JOIN l ON l.subject_id = f.subject_id AND l.object_id = f.object_id AND l.n = f.n + 1)
SELECT a.space_id, a.subject_id, a.predicate, a.object_id, a.audience, a.starts AS statement_id, {sql_iso('a.begun')} AS valid_from, {sql_iso('b.closed')} AS valid_to FROM f a LEFT JOIN f b ON b.ends = a.starts WHERE a.starts IS NOT NULL""")
def statement_log(s, d):
    """Statements that a log of adds and invalidations leaves, in its order: replays of a turn do not bring back what has ended."""
    e, n = load(s, d, "events"), F.col("event_id")
    rows = e.select(text_of("space_", F.col("user_id") % 4).alias("space_id"), text_of("user:", F.col("user_id")).alias("subject_id"), F.lit("likes").alias("predicate"), text_of("item:", F.regexp_extract("props", "[0-9]+", 0).cast("long") % 4).alias("object_id"), F.lit("owner").alias("audience"),
        n.alias("seq"), F.when(F.col("event_type").isin("purchase", "error"), F.lit("invalidate")).otherwise(F.lit("add")).alias("op"), text_of("stmt_", n).alias("statement_id"), text_of("turn_", n % 20).alias("turn_id"), F.col("ts").alias("at"))
    return keyed.statement_log(rows).withColumns({"valid_from": iso(F.col("valid_from")), "valid_to": iso(F.col("valid_to"))})


_REGISTER = "SELECT 'user:' || user_id AS subject_id, 'item:' || (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 3) AS object_id, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'invalidate' WHEN event_type = 'error' AND value < 20 THEN 'forget' ELSE 'register' END AS op, 'intent_' || (event_id % 40) AS intent_id, event_type AS payload, user_id % 2 = 0 AS single FROM events"
_OUTCOME = """CASE op WHEN 'register' THEN CASE WHEN list_contains(forgotten, l.object_id) THEN 'forgotten' WHEN NOT list_contains(active, l.object_id) AND NOT list_contains(inactive, l.object_id) AND single AND len(active) > 0 THEN 'slot conflict'
 WHEN list_contains(told, l.intent_id || '|' || l.object_id || '|' || payload) THEN 'replay' WHEN list_contains(seen, l.intent_id) THEN 'evidence conflict' WHEN list_contains(inactive, l.object_id) THEN 'inactive' WHEN list_contains(active, l.object_id) THEN 'evidence' ELSE 'created' END
 WHEN 'invalidate' THEN CASE WHEN list_contains(active, l.object_id) THEN 'invalidated' ELSE 'none' END ELSE CASE WHEN list_contains(active, l.object_id) OR list_contains(inactive, l.object_id) THEN 'erased' ELSE 'none' END END"""


@register("", f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY seq) AS n FROM ({_REGISTER})),
f AS (SELECT subject_id, 0::BIGINT AS n, 0::BIGINT AS seq, '' AS object_id, '' AS outcome, []::VARCHAR[] AS active, []::VARCHAR[] AS inactive, []::VARCHAR[] AS forgotten, []::VARCHAR[] AS seen, []::VARCHAR[] AS told, []::VARCHAR[] AS given FROM l WHERE n = 1
 UNION ALL SELECT s.subject_id, s.n, s.seq, s.object_id, s.outcome, CASE WHEN outcome = 'created' THEN list_append(active, object_id) WHEN outcome IN ('invalidated', 'erased') THEN list_filter(active, lambda x: x <> object_id) ELSE active END,
  CASE WHEN outcome = 'invalidated' THEN list_append(inactive, object_id) WHEN outcome = 'erased' THEN list_filter(inactive, lambda x: x <> object_id) ELSE inactive END, CASE WHEN outcome = 'erased' THEN list_append(forgotten, object_id) ELSE forgotten END,
  CASE WHEN outcome IN ('created', 'evidence') THEN list_append(seen, intent_id) ELSE seen END, CASE WHEN outcome IN ('created', 'evidence') THEN list_append(told, intent_id || '|' || object_id || '|' || payload) ELSE told END, CASE WHEN outcome IN ('created', 'evidence') THEN list_append(given, object_id) ELSE given END
 FROM (SELECT l.subject_id, l.n, l.seq, l.object_id, l.intent_id, l.payload, active, inactive, forgotten, seen, told, given, {_OUTCOME} AS outcome FROM f JOIN l ON l.subject_id = f.subject_id AND l.n = f.n + 1) s)
SELECT subject_id, object_id, seq, outcome, len(list_filter(given, lambda x: x = object_id))::BIGINT AS evidence FROM f WHERE n > 0""")
def canonical_register(s, d):
    """What registering, invalidating and forgetting facts in the order of the events comes to, for slots of one value and of many."""
    e, n = load(s, d, "events"), F.col("event_id")
    op = F.when(F.col("event_type") == "purchase", "invalidate").when((F.col("event_type") == "error") & (F.col("value") < 20), "forget").otherwise("register")
    rows = e.select(F.lit(SPACE).alias("space_id"), F.lit("owner").alias("audience"), text_of("user:", F.col("user_id")).alias("subject_id"), F.lit("owns").alias("predicate"), text_of("item:", F.regexp_extract("props", "[0-9]+", 0).cast("long") % 3).alias("object_id"),
        n.alias("seq"), op.alias("op"), text_of("intent_", n % 40).alias("intent_id"), F.col("event_type").alias("payload"), (F.col("user_id") % 2 == 0).alias("single"))
    return canonical.registered(rows).select("subject_id", "object_id", "seq", "outcome", "evidence")


@register("", """WITH RECURSIVE l AS (SELECT user_id AS fact_id, event_id AS seq, CASE WHEN event_type IN ('signup', 'error') THEN 'begin' ELSE 'mark' END AS op, value > 60 AS hard, props AS reason, CASE WHEN event_type = 'view' THEN ['drawer'] WHEN event_type = 'click' THEN ['kg'] WHEN value < 20 THEN ['drawer'] ELSE ['drawer', 'kg'] END AS targets,
 row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'purchase'),
f AS (SELECT fact_id, 0::BIGINT AS n, NULL::BOOLEAN AS hard, NULL::VARCHAR AS reason, 'not_required' AS drawer, 'not_required' AS kg FROM l WHERE n = 1
 UNION ALL SELECT f.fact_id, l.n, CASE WHEN op = 'begin' THEN coalesce(f.hard, false) OR l.hard ELSE f.hard END, CASE WHEN op = 'begin' AND (f.hard IS NULL OR l.hard AND NOT f.hard) THEN l.reason ELSE f.reason END,
  CASE WHEN list_contains(targets, 'drawer') THEN CASE WHEN op = 'begin' AND drawer = 'not_required' THEN 'pending' WHEN op = 'mark' AND drawer = 'pending' THEN 'projected' ELSE drawer END ELSE drawer END,
  CASE WHEN list_contains(targets, 'kg') THEN CASE WHEN op = 'begin' AND kg = 'not_required' THEN 'pending' WHEN op = 'mark' AND kg = 'pending' THEN 'projected' ELSE kg END ELSE kg END FROM f JOIN l ON l.fact_id = f.fact_id AND l.n = f.n + 1)
SELECT fact_id, hard, reason, drawer, kg, true AS blocks, drawer <> 'pending' AND kg <> 'pending' AS done FROM f WHERE hard IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY n DESC) = 1""")
def forget_states(s, d):
    """How far the forgetting of each fact has come: requests and marks of its projections, in the order of the events."""
    kind, v = F.col("event_type"), F.col("value")
    both = F.array(F.lit("drawer"), F.lit("kg"))
    targets = F.when(kind == "view", F.array(F.lit("drawer"))).when(kind == "click", F.array(F.lit("kg"))).when(v < 20, F.array(F.lit("drawer"))).otherwise(both)
    rows = load(s, d, "events").where(kind != "purchase").select(F.col("user_id").alias("fact_id"), F.col("event_id").alias("seq"), F.when(kind.isin("signup", "error"), "begin").otherwise("mark").alias("op"), (v > 60).alias("hard"), F.col("props").alias("reason"), targets.alias("targets"))
    return canonical.fold_forgets(rows, "fact_id")


@register("", """WITH d AS (SELECT 'space_' || (user_id % 4) AS space_id, 'turn_' || (event_id % 300) AS turn_id, CASE WHEN event_type = 'view' THEN 'provisional' ELSE event_type END AS version, event_id AS seq, props AS input_hash FROM events WHERE event_type <> 'error'),
t AS (SELECT 'space_' || (user_id % 4) AS space_id, 'turn_' || (event_id % 300) AS turn_id, min(event_id) AS gone FROM events WHERE event_type = 'error' AND value < 40 GROUP BY 1, 2),
w AS (SELECT d.*, gone, first_value(version) OVER (PARTITION BY space_id, turn_id ORDER BY seq) AS lead_version, row_number() OVER (PARTITION BY space_id, turn_id, version ORDER BY seq) AS n, first_value(input_hash) OVER (PARTITION BY space_id, turn_id, version ORDER BY seq) AS lead_hash FROM d LEFT JOIN t USING (space_id, turn_id))
SELECT space_id, turn_id, version, seq, CASE WHEN seq > gone THEN 'redacted' WHEN (version = 'provisional') <> (lead_version = 'provisional') THEN 'attribution conflict' WHEN n = 1 THEN 'stored' WHEN input_hash = lead_hash THEN 'replay' ELSE 'input conflict' END AS outcome FROM w""")
def decision_outcomes(s, d):
    """What putting extraction decisions if absent comes to, with tombstones and provisional sources."""
    e, n = load(s, d, "events"), F.col("event_id")
    turn = [text_of("space_", F.col("user_id") % 4).alias("space_id"), text_of("turn_", n % 300).alias("turn_id")]
    rows = e.where("event_type <> 'error'").select(*turn, F.when(F.col("event_type") == "view", "provisional").otherwise(F.col("event_type")).alias("version"), n.alias("seq"), F.col("props").alias("input_hash"))
    stones = e.where("event_type = 'error' and value < 40").select(*turn, n.alias("seq"))
    return ledgers.decided(rows, stones, "provisional").select("space_id", "turn_id", "version", "seq", "outcome")


@register("", None)
def commitment_apply(s, d):
    """Commitments with identity and condition: an order's lines of another action (by their tax) than its first are strangers."""
    return ledgers.applied_commitments(_applied_events(s, d), ["promisor", "action"]).withColumn("participants", F.array_join("participants", ",")).withColumn("due_at", iso(F.col("due_at")))


def _applied_events(s, d) -> DataFrame:
    action = F.when(F.col("l_tax") > 0.06, F.lit("other")).otherwise(F.lit("deliver"))
    return views.commitment_events(s, d, action=action, condition=F.when(F.col("l_discount") > 0.05, F.col("l_returnflag")))


_APPLY_STEP = _STEP.replace("e.status", "l.status")
ORACLES["commitment_apply"] = f"""WITH RECURSIVE a AS (SELECT o_orderkey AS commitment_id, l_shipdate, l_linenumber, l_partkey, l_suppkey, 'customer:' || o_custkey AS promisor, CASE WHEN l_linestatus = 'F' THEN (['confirmed', 'fulfilled', 'cancelled'])[l_linenumber % 3 + 1] ELSE (['proposed', 'confirmed'])[l_linenumber % 2 + 1] END AS status,
 'supplier:' || l_suppkey AS participant, CASE WHEN l_orderkey % 7 <> 0 THEN l_shipdate END AS due_at, CASE WHEN l_tax > 0.06 THEN 'other' ELSE 'deliver' END AS action, CASE WHEN l_discount > 0.05 THEN l_returnflag END AS condition FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT *, first_value(action) OVER (PARTITION BY commitment_id ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS lead_action FROM a),
l AS (SELECT *, row_number() OVER (PARTITION BY commitment_id ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS n FROM b WHERE action = lead_action),
f AS (SELECT commitment_id, n, CASE WHEN status = 'confirmed' THEN status ELSE 'proposed' END AS status, 1 AS revision, 0 AS rejected, [participant] AS participants, condition, due_at FROM l WHERE n = 1
 UNION ALL SELECT z.commitment_id, l.n, {_APPLY_STEP}, z.revision + ({_APPLY_STEP} = l.status)::INT, z.rejected + ({_APPLY_STEP} <> l.status)::INT, CASE WHEN {_APPLY_STEP} = l.status THEN list_distinct(list_append(z.participants, l.participant)) ELSE z.participants END,
  CASE WHEN {_APPLY_STEP} = l.status THEN coalesce(l.condition, z.condition) ELSE z.condition END, CASE WHEN {_APPLY_STEP} = l.status THEN coalesce(l.due_at, z.due_at) ELSE z.due_at END FROM f z JOIN l ON l.commitment_id = z.commitment_id AND l.n = z.n + 1)
SELECT commitment_id, status, revision, rejected, strangers, array_to_string(list_sort(participants), ',') AS participants, condition, {sql_iso('due_at')} AS due_at FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY commitment_id ORDER BY n DESC) = 1) JOIN (SELECT commitment_id, count(*) FILTER (action <> lead_action)::INT AS strangers FROM b GROUP BY 1) USING (commitment_id)"""


# quality


@register("", """SELECT category, count(*) AS n, count(*) FILTER (correct) AS correct, round(100 * count(*) FILTER (correct) / count(*), 1) AS correct_pct, round(sum(found) / greatest(sum(wanted), 1), 3) AS evidence_recall, sum(omissions)::BIGINT AS omissions, count(*) FILTER (abstains) AS abstention_total, count(*) FILTER (abstains AND abstained) AS abstention_correct,
 round(median(ms), 1) AS p50_ms, round(max(ms) FILTER (r = greatest(floor(0.95 * c), 1)), 1) AS p95_ms, round(avg(ms), 1) AS mean_ms FROM (SELECT event_type AS category, event_id % 3 = 0 AS correct, event_id % 4 AS found, 3 AS wanted, event_id % 2 AS omissions, event_id % 7 = 0 AS abstains, event_id % 14 = 0 AS abstained, value AS ms,
 row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events) GROUP BY 1""")
def quality_metrics(s, d):
    n = F.col("event_id")
    return evaluation.quality(load(s, d, "events").select(F.col("event_type").alias("category"), (n % 3 == 0).alias("correct"), (n % 4).alias("found"), F.lit(3).alias("wanted"), (n % 2).alias("omissions"), (n % 7 == 0).alias("abstains"), (n % 14 == 0).alias("abstained"), F.col("value").alias("ms")))


@register("statements entities", """, e AS (SELECT DISTINCT entity_id, regexp_matches(entity_id, '7$') AS p FROM entities), l AS (SELECT DISTINCT unnest([subject_id, object_id]) AS entity_id FROM statements WHERE subject_id <> object_id AND subject_id IN (SELECT entity_id FROM e WHERE NOT p) AND object_id IN (SELECT entity_id FROM e WHERE NOT p))
SELECT (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM e WHERE p) AS phrase_nodes, (SELECT count(*) FROM l) AS linked, round(100 * (SELECT count(*) FROM l) / greatest((SELECT count(*) FROM e WHERE NOT p), 1), 1) AS linked_pct,
 (SELECT count(*) FROM (SELECT 1 FROM e WHERE split_part(entity_id, ':', 1) IN ('user', 'mother') GROUP BY split_part(entity_id, ':', 1) HAVING count(*) > 1)) AS fragmented_roles, (SELECT count(*) FROM e WHERE NOT p AND split_part(entity_id, ':', 1) NOT IN ('user', 'mother', 'self')) AS ascii_named""")
def graph_connectivity(s, d):
    return evaluation.connectivity(views.statements(s, d), views.entities(s, d), "7$", ["user", "mother"])


_RUNS = """SELECT user_id AS name, CASE WHEN event_id % 29 = 0 THEN (['schema_invalid', 'provider_error', 'policy_rejected'])[event_id % 3 + 1] END AS error, (['none', 'create', 'update'])[user_id % 3 + 1] AS expected_operation, CASE WHEN event_id % 11 = 0 THEN 'create' ELSE (['none', 'create', 'update'])[user_id % 3 + 1] END AS actual_operation,
 CASE WHEN user_id % 3 = 1 THEN 'act' END AS expected_action, CASE WHEN event_id % 13 <> 0 THEN 'act' ELSE 'other' END AS actual_action, CASE WHEN user_id % 3 = 2 THEN 't1' END AS expected_target, CASE WHEN event_id % 17 <> 0 THEN 't1' END AS actual_target, (event_id % 10) / 10 AS confidence FROM events"""
_RIGHT = "error IS NULL AND actual_operation = expected_operation AND (expected_action IS NULL OR actual_action = expected_action) AND (expected_target IS NULL OR coalesce(actual_target, '') = expected_target)"
_RATES = {
    "operation_accuracy": "round(count(*) FILTER (error IS NULL AND actual_operation = expected_operation) / count(*) FILTER (error IS NULL), 6)",
    "action_exact_accuracy": "round(count(*) FILTER (error IS NULL AND expected_action IS NOT NULL AND actual_action = expected_action) / count(*) FILTER (error IS NULL AND expected_action IS NOT NULL), 6)",
    "target_top1_accuracy": "round(count(*) FILTER (error IS NULL AND expected_target IS NOT NULL AND actual_target = expected_target) / count(*) FILTER (error IS NULL AND expected_target IS NOT NULL), 6)",
    "none_false_positive_rate": "round(count(*) FILTER (error IS NULL AND expected_operation = 'none' AND actual_operation <> 'none') / count(*) FILTER (error IS NULL AND expected_operation = 'none'), 6)",
    "schema_failure_rate": "round(count(*) FILTER (error = 'schema_invalid') / count(*), 6)",
    "provider_failure_rate": "round(count(*) FILTER (error = 'provider_error') / count(*), 6)",
    "policy_rejection_rate": "round(count(*) FILTER (error = 'policy_rejected') / count(*), 6)",
    "high_confidence_errors": f"count(*) FILTER (error IS NULL AND confidence >= 0.8 AND NOT ({_RIGHT}))::DOUBLE",
}
_GATES = " + ".join([*(f"({c} >= {x})::INT" for c, x in evaluation.SHADOW_LEAST.items()), *(f"({c} <= {x})::INT" for c, x in evaluation.SHADOW_MOST.items()), *(f"({c} > 0)::INT" for c in ("action_cases", "target_cases", "none_cases")), "(min_runs >= 2)::INT"])


@register("", f"""WITH r AS ({_RUNS}), o AS (SELECT name, count(DISTINCT concat_ws('|', coalesce(error, ''), coalesce(actual_operation, ''), coalesce(actual_action, ''), coalesce(actual_target, ''))) = 1 AS same, bool_and({_RIGHT}) AS right_, count(*) AS runs FROM r GROUP BY 1),
m AS (SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS valid, {', '.join(f'{x} AS {c}' for c, x in _RATES.items())}, count(*) FILTER (error IS NULL AND expected_action IS NOT NULL) AS action_cases, count(*) FILTER (error IS NULL AND expected_target IS NOT NULL) AS target_cases, count(*) FILTER (error IS NULL AND expected_operation = 'none') AS none_cases,
 (SELECT count(*) FROM o) AS cases, (SELECT min(runs) FROM o) AS min_runs, (SELECT round(avg(same::INT), 6) FROM o) AS case_consistency_rate, (SELECT round(avg(right_::INT), 6) FROM o) AS all_runs_correct_rate FROM r)
SELECT *, {_GATES} AS gates_passed, {_GATES} = {len(evaluation.SHADOW_LEAST) + len(evaluation.SHADOW_MOST) + 4} AS overall_pass FROM m""")
def commitment_shadow(s, d):
    n, u = F.col("event_id"), F.col("user_id")
    expected = views.choose(u % 3, ["none", "create", "update"])
    rows = load(s, d, "events").select(
        u.alias("name"), F.when(n % 29 == 0, views.choose(n % 3, ["schema_invalid", "provider_error", "policy_rejected"])).alias("error"), expected.alias("expected_operation"), F.when(n % 11 == 0, F.lit("create")).otherwise(expected).alias("actual_operation"),
        F.when(u % 3 == 1, F.lit("act")).alias("expected_action"), F.when(n % 13 != 0, F.lit("act")).otherwise(F.lit("other")).alias("actual_action"), F.when(u % 3 == 2, F.lit("t1")).alias("expected_target"), F.when(n % 17 != 0, F.lit("t1")).alias("actual_target"), ((n % 10) / 10).alias("confidence"),
    )
    return evaluation.shadow_scores(rows)


# listings and statuses


_PREVIEW = r"trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}]+', ' ', 'g'))"


@register("drawers", f"""SELECT wing, room, drawers, array_to_string(p[1:3], '|') AS previews, len(p) > 3 AS truncated FROM (SELECT wing, room, sum(n)::BIGINT AS drawers, list(preview ORDER BY first) AS p FROM (SELECT wing, room, preview, count(*) AS n, min(drawer_id) AS first FROM (
 SELECT wing, room, drawer_id, CASE WHEN length({_PREVIEW}) > 96 THEN substr({_PREVIEW}, 1, 96) || '…' ELSE {_PREVIEW} END AS preview FROM drawers) GROUP BY 1, 2, 3) GROUP BY 1, 2) UNION ALL SELECT 'Wing_Spare', NULL, 0, '', false""")
def hierarchy_snapshot(s, d):
    return browse.hierarchy(views.drawers(s, d), [*views.WINGS, "Wing_Spare"]).withColumn("previews", F.array_join("previews", "|"))


@register("visible_drawers", f"SELECT drawer_id, {sql_iso('v.memory_time')} AS memory_time, (SELECT count(*) > 10 FROM visible_drawers WHERE memory_time >= TIMESTAMP '2024-01-02' AND memory_time < TIMESTAMP '2024-01-20') AS more_in_window, (SELECT count(*) FROM visible_drawers WHERE memory_time IS NULL) AS undated_count FROM visible_drawers v WHERE v.memory_time >= TIMESTAMP '2024-01-02' AND v.memory_time < TIMESTAMP '2024-01-20' ORDER BY v.memory_time DESC, drawer_id DESC LIMIT 10")
def entries_window(s, d):
    return browse.entries_with_counts(recallable(s, d), 10, graph.time("2024-01-02T00:00:00"), graph.time("2024-01-20T00:00:00")).select("drawer_id", iso(F.col("memory_time")).alias("memory_time"), "more_in_window", "undated_count")


@register("visible_drawers", f"SELECT {', '.join(c if c != 'memory_time' else sql_iso('v.memory_time') + ' AS memory_time' for c in browse.EXPORTED)} FROM visible_drawers v")
def export_records(s, d):
    return browse.export(views.drawers(s, d), visibility.visible(CALLER)).select(*browse.EXPORTED).withColumn("memory_time", iso(F.col("memory_time")))


@register("drawers", "SELECT a.room, b.room AS other, count(*) AS shared FROM (SELECT DISTINCT room, wing FROM drawers) a JOIN (SELECT DISTINCT room, wing FROM drawers) b ON a.wing = b.wing AND a.room < b.room GROUP BY 1, 2 ORDER BY shared DESC, a.room, other LIMIT 3")
def room_edges_capped(s, d):
    return browse.capped_edges(views.drawers(s, d), 3)


@register("drawers", f"""SELECT drawer_id FROM drawers WHERE wing <> 'Wing_Privacy' AND space_id = 'space_0' AND privacy NOT IN ('do_not_recall', 'private') AND visibility <> 'private' AND {_DEVICE}""")
def owner_recollections(s, d):
    """What the owner sees in their own memory: every audience."""
    return views.drawers(s, d).where(visibility.visible(recall.owner_view(CALLER))).select("drawer_id")


@register("", "SELECT event_type, count(*) AS n, max(value) FILTER (r = greatest(ceil(0.5 * c), 1)) AS p50, max(value) FILTER (r = greatest(ceil(0.99 * c), 1)) AS p99 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL) GROUP BY 1")
def percentiles_rounded_up(s, d):
    return evaluation.nearest_rank(load(s, d, "events"), "event_type", "value", [0.5, 0.99], up=True)


@register("claims", """, p AS (SELECT kind, subject, object, count(*) AS p FROM claims WHERE confidence >= 0.3 GROUP BY ALL), g AS (SELECT kind, subject, object, count(*) AS g FROM claims WHERE fact_confidence >= 0.25 GROUP BY ALL),
b AS (SELECT kind, sum(least(coalesce(p, 0), coalesce(g, 0)))::BIGINT AS matched, sum(coalesce(p, 0))::BIGINT AS proposed, sum(coalesce(g, 0))::BIGINT AS gold FROM p FULL JOIN g USING (kind, subject, object) GROUP BY 1)
SELECT *, round(matched / proposed, 6) AS precision, round(matched / gold, 6) AS recall, CASE kind WHEN 'triple' THEN round(matched / proposed, 6) >= 0.85 AND round(matched / gold, 6) >= 0.70 WHEN 'invalidation' THEN round(matched / proposed, 6) >= 0.90 AND round(matched / gold, 6) >= 0.80 ELSE true END AS passed FROM b""")
def extraction_gates(s, d):
    rows = views.claims(s, d)
    return evaluation.extraction_gates(rows.where("confidence >= 0.3"), rows.where("fact_confidence >= 0.25"), ["subject", "object"])


@register("", """WITH c AS (SELECT o_orderkey AS commitment_id, (['proposed', 'fulfilled', 'confirmed', 'cancelled'])[o_orderkey % 4 + 1] AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS due_at, o_orderdate AS updated_at FROM orders)
SELECT commitment_id, status, (SELECT count(*) FROM c) AS total, (SELECT count(*) > 50 FROM c) AS truncated FROM c ORDER BY status IN ('proposed', 'confirmed') DESC, CASE WHEN status IN ('proposed', 'confirmed') THEN due_at END ASC NULLS LAST, updated_at DESC NULLS LAST, commitment_id LIMIT 50""")
def commitment_listing(s, d):
    k = F.col("o_orderkey")
    rows = load(s, d, "orders").select(k.alias("commitment_id"), views.choose(k % 4, ["proposed", "fulfilled", "confirmed", "cancelled"]).alias("status"), F.when(k % 3 != 0, F.col("o_orderdate")).alias("due_at"), F.col("o_orderdate").alias("updated_at"))
    return ledgers.commitment_listing(rows, 50).select("commitment_id", "status", "total", "truncated")


@register("canonical", """SELECT pending, CASE WHEN pending > 0 THEN 'materializing' ELSE 'ready' END AS state FROM (SELECT (count(*) FILTER (state = 'active' AND drawer = 'pending') + count(*) FILTER (state = 'active' AND kg = 'pending') + sum(invalidations_pending) + sum(supersessions_pending) + sum(reactivations_pending)
 + count(*) FILTER (state = 'forgotten' AND drawer = 'pending') + count(*) FILTER (state = 'forgotten' AND kg = 'pending'))::BIGINT AS pending FROM canonical)""")
def materialization_status(s, d):
    return ledgers.materialization_status(canonical.stats(canonical.fold(views.canonical_events(s, d))), F.lit(0))


@register("", """SELECT event_id AS seq, CASE WHEN event_id % 7 <> 0 THEN (['remember', 'forget', 'correct', 'add_triple', 'invalidate', 'commitment', 'dance'])[event_id % 7 + 1] ELSE 'remember' END AS command, CASE WHEN event_id % 5 <> 0 THEN 'r' || event_id ELSE '' END AS request_id,
 CASE WHEN event_id % 7 = 6 THEN 'unknown command' WHEN event_id % 5 = 0 THEN 'command without id' END AS error FROM events WHERE event_id % 2 = 0""")
def command_parse(s, d):
    n = F.col("event_id")
    body = F.to_json(F.struct(views.choose(n % 7, [*storage.COMMANDS, "dance"]).alias("kind"), F.when(n % 5 != 0, text_of("r", n)).otherwise(F.lit("")).alias("request_id"), F.lit("space_0").alias("memory_space_id")))
    value = F.to_json(F.struct(F.when(n % 2 == 0, F.lit("memory_command")).otherwise(F.lit("device_sync")).alias("kind"), body.alias("payload")))
    return storage.commands_of(load(s, d, "events").select(n.alias("seq"), value.alias("value"))).select("seq", "command", "request_id", "error")
