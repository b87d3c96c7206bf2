"""Every registered query of the library and its equivalent SQL (over the views of oracle_views)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallspark.functions import ids
from recallspark.operators import browse, evaluation, graph, ledgers, retrieval, visibility
from recallspark.operators.scratch import written
from recallspark.plans.oracle_views import iso as sql_iso
from recallspark.plans.oracle_views import sql
from recallspark.sources import views
from recallspark.sources.views import iso, load

FLAGSHIP = "fused_recall"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The moment and the callers that the queries speak for.
AS_OF, CURSOR = "2024-01-16 00:00:00", ("2024-01-10T00:00:00", "stmt_5")
READERS, SPACE = ["owner", "companion:c0"], "space_0"
CALLER = visibility.Caller("space_0", tuple(READERS), session_id="session_1", person_id="person_0", device_id="device_2")
TURNS = [f"turn_{k}" for k in range(0, 500, 25)]
PHRASE = "andthe"

_T = f"TIMESTAMP '{AS_OF}'"
_VALID = f"(valid_from IS NULL OR valid_from <= {_T}) AND (valid_to IS NULL OR valid_to > {_T})"
_READ = "audience IN ('owner', 'companion:c0')"
_SEEN, _HERE = f"{_READ} AND NOT sensitive", f"space_id = '{SPACE}'"
_ORDER = "confidence DESC NULLS LAST, valid_from DESC NULLS LAST, recorded_at DESC NULLS LAST, statement_id"
_TURNS = f"source_turn_id IN ({', '.join(repr(t) for t in TURNS)})"
_S = f"statement_id, subject_id, predicate, object_id, {sql_iso('valid_from')} AS valid_from, confidence"
_ENDS = "SELECT *, unnest(CASE WHEN subject_id = object_id THEN [subject_id] ELSE [subject_id, object_id] END) AS entity_id FROM"


def register(views_of: str, oracle: str | None):
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(views_of, oracle)
        return f

    return keep


def at() -> F.Column:
    return graph.time(AS_OF)


def short(df: DataFrame, *more: str) -> DataFrame:
    return df.select("statement_id", "subject_id", "predicate", "object_id", iso(F.col("valid_from")).alias("valid_from"), "confidence", *more)


def seen(s, d, as_of: bool = True, space: str | None = None) -> DataFrame:
    return graph.visible(views.statements(s, d), READERS, at() if as_of else None, space=space)


def recallable(s, d) -> DataFrame:
    """The drawers that the caller may see."""
    return views.drawers(s, d).where(visibility.visible(CALLER))


# graph


@register("statements entities", f"""SELECT s.subject_id, a.name AS subject, predicate, b.name AS object, statement_id, confidence, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY space_id, subject_id ORDER BY {_ORDER}) AS rank FROM statements WHERE {_SEEN} AND {_VALID}) s
 JOIN entities a ON a.entity_id = subject_id AND a.space_id = s.space_id JOIN entities b ON b.entity_id = object_id AND b.space_id = s.space_id WHERE rank <= 8""")
def kg_subject_topn(s, d):
    return graph.with_names(graph.top_per_subject(seen(s, d), 8), views.entities(s, d)).select("subject_id", "subject", "predicate", "object", "statement_id", "confidence", "rank")


for _name, _where, _entity in (("outgoing", "subject_id = 'user:8'", "user:8"), ("incoming", "object_id = 'item:9'", "item:9"), ("both", "subject_id = 'user:8' OR object_id = 'user:8'", "user:8")):

    def _read(s, d, entity=_entity, direction=_name):
        return short(graph.entity_read(seen(s, d, space=SPACE), entity, direction))

    _read.__name__ = f"kg_entity_{_name}"
    register("statements", f"SELECT {_S} FROM statements s WHERE {_HERE} AND {_SEEN} AND {_VALID} AND ({_where}) ORDER BY {_ORDER.replace('valid_from', 's.valid_from')} LIMIT 200")(_read)


@register("statements", f"""SELECT {_S}, seed FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY seed) AS n FROM (
 SELECT *, row_number() OVER (PARTITION BY seed ORDER BY {_ORDER}) AS rank FROM (SELECT *, CASE entity_id WHEN 'user:8' THEN 0 WHEN 'item:9' THEN 1 WHEN 'user:4' THEN 2 END AS seed FROM ({_ENDS} statements WHERE {_HERE} AND {_SEEN} AND {_VALID}))
 WHERE seed IS NOT NULL) WHERE rank <= 8) WHERE n = 1""")
def kg_entity_combined(s, d):
    return short(graph.read_combined(seen(s, d, space=SPACE), ["user:8", "item:9", "user:4"], 8), F.col("seed").cast("int").alias("seed"))


@register("statements", f"SELECT {_S} FROM statements s WHERE {_HERE} AND {_READ} AND (s.valid_from IS NULL OR (s.valid_from >= TIMESTAMP '2024-01-05' AND s.valid_from < {_T})) ORDER BY recorded_at DESC, statement_id DESC LIMIT 100")
def kg_timeline(s, d):
    rows = graph.visible(views.statements(s, d), READERS, sensitive=True, space=SPACE)
    return short(graph.timeline(rows, since=graph.time("2024-01-05T00:00:00"), until=at()))


@register("statements", f"SELECT {_S} FROM statements s WHERE space_id = 'space_0' AND (recorded_at < TIMESTAMP '2024-01-10' OR recorded_at = TIMESTAMP '2024-01-10' AND statement_id < 'stmt_5') AND (subject_id = 'user:8' OR object_id = 'user:8') ORDER BY recorded_at DESC, statement_id DESC LIMIT 100")
def kg_timeline_keyset(s, d):
    return short(graph.timeline(graph.visible(views.statements(s, d), None, sensitive=True, space=SPACE), "user:8", after=CURSOR))


@register("statements", f"SELECT {_S} FROM statements s WHERE {_READ} AND {_VALID.replace('valid_from', 's.valid_from')} ORDER BY recorded_at DESC, statement_id DESC LIMIT 50")
def kg_current_snapshot(s, d):
    return short(graph.timeline(graph.visible(views.statements(s, d), READERS, sensitive=True), current=at(), limit=50))


@register("statements", f"SELECT {_S} FROM statements s WHERE {_VALID.replace('valid_from', 's.valid_from')}")
def kg_asof_history(s, d):
    return short(graph.visible(views.statements(s, d), None, at(), sensitive=True))


@register("statements entities", f"SELECT name, CAST(count(*) AS BIGINT) AS hits FROM ({_ENDS} statements WHERE {_TURNS}) JOIN entities USING (space_id, entity_id) GROUP BY name ORDER BY hits DESC, name LIMIT 20")
def kg_turn_entities(s, d):
    return graph.entities_of_turns(views.statements(s, d), views.entities(s, d), TURNS, 20)


@register("statements", f"""SELECT DISTINCT ON (statement_id) {_S} FROM (SELECT * FROM (SELECT DISTINCT ON (statement_id) * FROM ({_ENDS} statements WHERE {_HERE} AND {_SEEN} AND {_VALID}) WHERE entity_id IN (
 SELECT entity_id FROM (SELECT entity_id, count(*) AS hits FROM ({_ENDS} statements WHERE {_HERE} AND {_SEEN} AND {_TURNS}) GROUP BY 1 ORDER BY hits DESC, entity_id LIMIT 3))) ORDER BY {_ORDER} LIMIT 24)""")
def kg_one_hop_expand(s, d):
    return short(graph.expand_one_hop(seen(s, d, False, SPACE), TURNS, at(), 3, 24))


_MATCH = "SELECT phrase_id, entity_id, length, rank FROM (SELECT *, row_number() OVER (PARTITION BY phrase_id ORDER BY length DESC, entity_id) AS rank FROM (SELECT phrase_id, entity_id, max(length(match)) AS length FROM phrases p JOIN ({}) n ON p.space_id = n.space_id AND contains({}, match) AND match <> '' GROUP BY 1, 2)) WHERE rank <= 3"


def _longest(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """The three entities with the longest names in each phrase."""
    hits = graph.match_names(phrases, names).groupBy("phrase_id", "entity_id").agg(F.max(F.char_length("match")).alias("length"))
    place = Window.partitionBy("phrase_id").orderBy(F.desc("length"), "entity_id")
    return hits.withColumn("rank", F.row_number().over(place)).where("rank <= 3")


@register("entities phrases", _MATCH.format("SELECT space_id, entity_id, name AS match FROM entities", "phrase"))
def kg_match_whole(s, d):
    return _longest(views.phrases(s, d), views.entities(s, d).select("space_id", "entity_id", F.col("name").alias("match")))


@register("entities phrases", _MATCH.format("SELECT space_id, entity_id, CASE WHEN contains(name, ':') THEN substr(name, instr(name, ':') + 1) END AS match FROM entities", "phrase"))
def kg_match_tail(s, d):
    return _longest(views.phrases(s, d), views.entities(s, d).select("space_id", "entity_id", graph.tail(F.col("name")).alias("match")).where("match is not null"))


@register("mentions phrases", _MATCH.format("SELECT space_id, entity_id, alias AS match FROM mentions WHERE confidence >= 0.85", "lower(phrase)"))
def kg_match_alias(s, d):
    names = views.mentions(s, d).where("confidence >= 0.85").select("space_id", "entity_id", F.col("alias").alias("match"))
    return _longest(views.phrases(s, d).withColumn("phrase", F.lower("phrase")), names)


_STAGED = """, hits AS (
 SELECT phrase_id, name, 0 AS stage, -length(name) AS short FROM phrases JOIN entities USING (space_id) WHERE name <> '' AND contains(phrase, name)
 UNION ALL SELECT phrase_id, name, 1, -length(name) FROM phrases JOIN entities USING (space_id) WHERE contains(name, ':') AND substr(name, instr(name, ':') + 1) <> '' AND contains(phrase, substr(name, instr(name, ':') + 1))
 UNION ALL SELECT phrase_id, name, 2, -length(alias) FROM phrases JOIN mentions USING (space_id) JOIN entities USING (space_id, entity_id) WHERE audience IN ('owner', 'companion:c0') AND confidence >= {} AND contains(lower(phrase), alias)),
matched AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phrase_id ORDER BY stage, short, name) AS rank FROM (SELECT phrase_id, name, min((stage, short))[1] AS stage, min((stage, short))[2] AS short FROM hits WHERE stage >= {} GROUP BY 1, 2)) WHERE rank <= {})
"""


@register("entities mentions phrases", _STAGED.format(0, 0, 3) + "SELECT phrase_id, name, stage, rank FROM matched")
def kg_match_names(s, d):
    return graph.matched_entities(views.phrases(s, d), views.entities(s, d), views.mentions(s, d), READERS)


@register("entities mentions phrases statements", _STAGED.format(0.85, 2, 2) + f""", facts AS (SELECT DISTINCT s.space_id, name FROM statements s JOIN entities e ON e.space_id = s.space_id AND e.entity_id IN (s.subject_id, s.object_id) WHERE {_SEEN} AND {_VALID}
 UNION SELECT space_id, name FROM entities WHERE entity_id IN ('nation:1', 'nation:6', 'nation:12')),
one AS (SELECT phrase_id, min(name) AS name FROM matched GROUP BY 1 HAVING count(*) = 1)
SELECT phrase_id, CASE WHEN f.name IS NOT NULL AND NOT contains(phrase, o.name) THEN phrase || ' ' || o.name ELSE phrase END AS query FROM phrases p LEFT JOIN one o USING (phrase_id) LEFT JOIN facts f ON f.space_id = p.space_id AND f.name = o.name""")
def alias_query_rewrite(s, d):
    """Phrases with the name of their one sure alias, where something visible is known of it (statements, or what is noted of three nations)."""
    phrases, entities = views.phrases(s, d), views.entities(s, d)
    sure = graph.matched_entities(phrases, entities, views.mentions(s, d), READERS, cap=2, least=0.85, aliases_only=True)
    ends = seen(s, d).select("space_id", F.explode(F.array("subject_id", "object_id")).alias("entity_id"))
    noted = entities.where(F.col("entity_id").isin("nation:1", "nation:6", "nation:12")).select("space_id", "name")
    return graph.rewritten(phrases, sure, ends.join(entities, ["space_id", "entity_id"]).select("space_id", "name").unionByName(noted))


@register("entities mentions phrases", _STAGED.format(0, 0, 3) + """, seeds AS (SELECT phrase_id, 0 AS side, 0 AS at_, 'item:9' AS name FROM (SELECT DISTINCT phrase_id FROM matched) UNION ALL SELECT phrase_id, 1, rank, name FROM matched)
SELECT phrase_id, name, place FROM (SELECT *, row_number() OVER (PARTITION BY phrase_id ORDER BY b, name) AS place FROM (SELECT phrase_id, name, min((side, at_)) AS b FROM seeds GROUP BY 1, 2)) WHERE place <= 3""")
def kg_recall_seeds(s, d):
    return graph.seeded(["item:9"], graph.matched_entities(views.phrases(s, d), views.entities(s, d), views.mentions(s, d), READERS))


@register("statements entities mentions", "SELECT *, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM mentions) AS mentions FROM (SELECT count(*) AS statements, count(*) FILTER (valid_to IS NULL) AS active, count(*) FILTER (valid_to IS NOT NULL) AS invalidated, count(*) FILTER (sensitive) AS sensitive FROM statements)")
def kg_stats(s, d):
    return graph.stats(views.statements(s, d), views.entities(s, d), views.mentions(s, d))


@register("statements", f"SELECT entity_id, count(*) AS degree FROM (SELECT unnest([subject_id, object_id]) AS entity_id FROM statements WHERE {_SEEN}) GROUP BY 1 ORDER BY degree DESC, entity_id LIMIT 50")
def kg_graph_degree(s, d):
    return graph.degrees(seen(s, d, False), 50)


@register("statements", "SELECT space_id, audience, count(*) AS statements, count(DISTINCT predicate) AS predicates FROM statements GROUP BY ALL")
def kg_known_audiences(s, d):
    return views.statements(s, d).groupBy("space_id", "audience").agg(F.count("*").alias("statements"), F.count_distinct("predicate").alias("predicates"))


_KEY = "space_id, subject_id, predicate, object_id, audience"


@register("statements", f"""SELECT {_S} FROM (SELECT *, count(*) FILTER (valid_to IS NULL) OVER (PARTITION BY {_KEY} ORDER BY recorded_at, statement_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened FROM (
 SELECT *, row_number() OVER (PARTITION BY {_KEY}, source_turn_id ORDER BY recorded_at, statement_id) AS m FROM (SELECT *, row_number() OVER (PARTITION BY space_id, projection_id ORDER BY recorded_at, statement_id) AS n FROM statements)
 WHERE n = 1 OR projection_id IS NULL) WHERE m = 1) s WHERE coalesce(opened, 0) = 0""")
def kg_add_idempotent(s, d):
    return short(graph.add_triples(views.statements(s, d)))


@register("statements", """SELECT statement_id, projection_id FROM (SELECT *, first_value((subject_id, predicate, object_id, audience)) OVER (PARTITION BY space_id, projection_id ORDER BY recorded_at, statement_id) AS f FROM statements WHERE projection_id IS NOT NULL)
WHERE f <> (subject_id, predicate, object_id, audience)""")
def kg_projection_conflicts(s, d):
    return graph.projection_conflicts(views.statements(s, d)).select("statement_id", "projection_id")


@register("statements", f"""SELECT s.statement_id, {sql_iso("coalesce(any_value(s.valid_to), min(e.ended_at))")} AS valid_to FROM statements s LEFT JOIN (SELECT space_id, subject_id, predicate, object_id, recorded_at AS ended_at FROM statements WHERE audience = 'owner') e
 ON s.valid_to IS NULL AND {_READ.replace('audience', 's.audience')} AND s.space_id = e.space_id AND s.subject_id = e.subject_id AND s.predicate = e.predicate AND s.object_id = e.object_id AND (s.valid_from IS NULL OR e.ended_at > s.valid_from) GROUP BY s.statement_id""")
def kg_invalidate_fold(s, d):
    rows = views.statements(s, d)
    ends = rows.where("audience = 'owner'").withColumnRenamed("recorded_at", "ended_at")
    return graph.invalidate(rows, ends, READERS).select("statement_id", iso(F.col("valid_to")).alias("valid_to"))


@register("statements", f"""SELECT statement_id, {sql_iso("least(valid_to, follows)")} AS valid_to FROM (SELECT *, CASE WHEN predicate IN ('works_at', 'owns') THEN lead(valid_from) OVER (PARTITION BY space_id, audience, subject_id, predicate ORDER BY valid_from ASC NULLS FIRST, statement_id) END AS follows FROM statements)""")
def kg_supersede(s, d):
    return graph.supersede(views.statements(s, d), ["works_at", "owns"]).select("statement_id", iso(F.col("valid_to")).alias("valid_to"))


@register("statements", """SELECT a.space_id, a.subject_id, a.predicate, a.object_id, a.audience, s.space_id IS NOT NULL AS known, coalesce(o, 0) > 0 AS open, coalesce(c, 0) > 0 AS closed FROM (
 SELECT DISTINCT space_id, subject_id, predicate, object_id, 'owner' AS audience FROM statements WHERE audience <> 'owner') a LEFT JOIN (
 SELECT space_id, subject_id, predicate, object_id, audience, count(*) FILTER (valid_to IS NULL) AS o, count(*) FILTER (valid_to IS NOT NULL) AS c FROM statements GROUP BY ALL) s USING (space_id, subject_id, predicate, object_id, audience)""")
def kg_probes(s, d):
    rows = views.statements(s, d)
    asked = rows.where("audience <> 'owner'").select("space_id", "subject_id", "predicate", "object_id", F.lit("owner").alias("audience")).distinct()
    return graph.probes(asked, rows)


@register("mentions", """SELECT space_id, audience || ':' || entity_id || ':' || lower(trim(alias)) AS mention_id, max(confidence) AS confidence FROM (SELECT * FROM mentions UNION ALL SELECT space_id, entity_id, ' ' || upper(alias), confidence, audience FROM mentions) GROUP BY 1, 2""")
def kg_mention_upsert(s, d):
    once = views.mentions(s, d).withColumn("recorded_at", F.lit(0))
    again = once.withColumn("alias", F.concat(F.lit(" "), F.upper("alias"))).withColumn("recorded_at", F.lit(1))
    return graph.distinct_mentions(once.unionByName(again)).select("space_id", "mention_id", "confidence")


@register("statements", f"SELECT {_S} FROM statements s WHERE NOT ({_TURNS})")
def kg_soft_forget(s, d):
    return short(graph.forget(views.statements(s, d), s.createDataFrame([(t,) for t in TURNS], "source_turn_id string")))


@register("statements entities", "SELECT space_id, entity_id, name FROM entities WHERE (space_id, entity_id) NOT IN (SELECT (space_id, unnest([subject_id, object_id])) FROM statements WHERE predicate IN ('likes', 'works_at'))")
def kg_hard_forget_orphans(s, d):
    return graph.orphans(views.statements(s, d).where("predicate in ('likes', 'works_at')"), views.entities(s, d)).select("space_id", "entity_id", "name")


@register("statements", f"SELECT CASE WHEN {_TURNS} THEN 'owner' ELSE audience END AS audience, count(*) AS statements FROM statements GROUP BY 1")
def kg_move_audience(s, d):
    moved = graph.move_audience(views.statements(s, d), s.createDataFrame([(t,) for t in TURNS], "source_turn_id string"), "owner")
    return moved.groupBy("audience").agg(F.count("*").alias("statements"))


_TOP = f"SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS ordinal FROM statements WHERE {_HERE} AND {_SEEN} AND {_VALID} AND {{}} QUALIFY ordinal <= 30"
_MERGED = f"""(SELECT s.*, source_turn_id IN (SELECT source_turn_id FROM drawers WHERE drawer_id < 40) AS restates FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY side, ordinal) AS n FROM (
 SELECT *, 0 AS side FROM ({_TOP.format("subject_id = 'user:8'")}) UNION ALL SELECT *, 1 FROM ({_TOP.format("object_id = 'item:9'")}))) s WHERE n = 1 ORDER BY restates, side, ordinal LIMIT 24)"""


def _merged(s, d) -> DataFrame:
    rows, shown = seen(s, d, space=SPACE), views.drawers(s, d).where("drawer_id < 40")
    return graph.merge_triples(graph.ordered(rows.where(graph.touches("user:8", "outgoing")), 30), graph.ordered(rows.where(graph.touches("item:9", "incoming")), 30), shown)


@register("statements drawers", f"SELECT {_S}, restates FROM {_MERGED} s")
def triple_merge(s, d):
    return short(_merged(s, d), "restates")


# records and retrieval


def asked(s, d) -> DataFrame:
    """Recall queries: benchmark items, with the vector that stands for their text where there is one."""
    v = load(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return load(s, d, "benchmark").join(v, F.col("vec_id") == 50 * F.col("item_id"), "left").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), "v")


def asked_vectors(s, d) -> DataFrame:
    """The stated query set."""
    return asked(s, d).select("query_id", "v")


@register("visible_drawers", f"SELECT drawer_id, wing, room, audience, {sql_iso('memory_time')} AS memory_time FROM visible_drawers d")
def visible_drawers(s, d):
    return recallable(s, d).select("drawer_id", "wing", "room", "audience", iso(F.col("memory_time")).alias("memory_time"))


@register("drawers", "SELECT drawer_id, layer FROM drawers WHERE wing <> 'Wing_Privacy' AND layer = 'household' AND privacy NOT IN ('do_not_recall') AND space_id = 'space_1' AND visibility <> 'current_device'")
def visible_household_every_audience(s, d):
    caller = visibility.Caller("space_1", (), include_private=True, every_audience=True, layers=("household",))
    return views.drawers(s, d).where(visibility.visible(caller)).select("drawer_id", "layer")


@register("vector", "SELECT query_id, drawer_id, similarity, rank FROM vector WHERE rank <= 10")
def vector_topk(s, d):
    return retrieval.vector_candidates(recallable(s, d), asked_vectors(s, d), 10).select("query_id", "drawer_id", "similarity", "rank")


@register("vector", "SELECT query_id, wing, drawer_id, similarity, rank FROM (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id, wing ORDER BY similarity DESC NULLS LAST, drawer_id) AS rank FROM vector) WHERE rank <= 3")
def vector_topk_per_wing(s, d):
    return retrieval.vector_candidates(recallable(s, d), asked_vectors(s, d), 3, ["wing"]).select("query_id", "wing", "drawer_id", "similarity", "rank")


@register("vector closets", """, near AS (SELECT * FROM vector WHERE rank <= 10), c AS (SELECT * FROM (SELECT query_id, source_file, 1 - round(list_cosine_similarity(embedding, v), 6) AS distance,
 row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(embedding, v), 6) DESC NULLS LAST, drawer_id) AS rank FROM closets CROSS JOIN queries WHERE v IS NOT NULL) WHERE rank <= 20),
f AS (SELECT query_id, source_file, min((rank, distance)) AS b FROM c GROUP BY 1, 2)
SELECT n.query_id, n.drawer_id, round(greatest(0, least(2, 1 - similarity - CASE WHEN round(b[2], 6) <= 1.5 THEN CASE b[1] WHEN 1 THEN 0.4::DOUBLE WHEN 2 THEN 0.25 WHEN 3 THEN 0.15 WHEN 4 THEN 0.08 WHEN 5 THEN 0.04 ELSE 0 END ELSE 0 END)), 6) AS distance
FROM near n LEFT JOIN f USING (query_id, source_file)""")
def closet_boost(s, d):
    rows, closets = recallable(s, d), views.closets(s, d)
    near = retrieval.vector_candidates(closets, asked_vectors(s, d), 20).join(closets.select("drawer_id", "source_file"), "drawer_id")
    found = retrieval.vector_candidates(rows, asked_vectors(s, d), 10).join(rows.select("drawer_id", "source_file"), "drawer_id")
    return retrieval.closet_boost(found, near, 10).select("query_id", "drawer_id", "distance")


@register("lexical", "SELECT query_id, drawer_id, score, rank FROM lexical WHERE rank <= 10")
def bm25_topk(s, d):
    return retrieval.bm25(recallable(s, d), asked(s, d), 10).select("query_id", "drawer_id", "score", "rank")


def _fused(s, d, k: int = 20) -> DataFrame:
    """The k best records of each query, of few rows each and written once."""
    rows = recallable(s, d)
    return written(retrieval.fuse(retrieval.vector_candidates(rows, asked_vectors(s, d), 30), retrieval.bm25(rows, asked(s, d), 30), k), "fused")


@register("fused", "SELECT query_id, drawer_id, rrf, rank FROM fused")
def hybrid_rrf(s, d):
    return _fused(s, d).select("query_id", "drawer_id", "rrf", "rank")


@register("placed", "SELECT query_id, drawer_id, CAST(tier AS DOUBLE) AS tier, place FROM placed")
def policy_rank(s, d):
    return retrieval.policy_rank(_fused(s, d), recallable(s, d), CALLER, 8).select("query_id", "drawer_id", "tier", "place")


@register("visible_drawers queries", """SELECT query_id, drawer_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, drawer_id) AS rank FROM (
 SELECT query_id, drawer_id, round(list_cosine_similarity(embedding, v), 6) AS similarity FROM visible_drawers CROSS JOIN queries WHERE wing = 'Wing_Theme' AND embedding IS NOT NULL AND v IS NOT NULL)) WHERE rank <= 3 AND similarity >= 0.05""")
def theme_channel(s, d):
    return retrieval.theme_channel(recallable(s, d), asked_vectors(s, d), floor=0.05).select("query_id", "drawer_id", "similarity")


@register("placed", f"SELECT query_id, place, drawer_id, wing, source_turn_id, {sql_iso('memory_time')} AS memory_time, rrf, similarity FROM placed JOIN (SELECT drawer_id, wing, source_turn_id, memory_time FROM drawers) d USING (drawer_id)")
def fused_recall(s, d):
    """Recall in one plan: visible drawers by vector and by words, fused, then ranked by scope."""
    rows = recallable(s, d)
    best = retrieval.policy_rank(_fused(s, d), rows, CALLER, 8)
    return best.join(rows.select("drawer_id", "wing", "source_turn_id", "memory_time"), "drawer_id").select("query_id", "place", "drawer_id", "wing", "source_turn_id", iso(F.col("memory_time")).alias("memory_time"), "rrf", "similarity")


_GROUPS = "CASE WHEN wing = 'Wing_Theme' THEN 0 " + " ".join(f"WHEN memory_type IN ({', '.join(repr(k) for k in kinds)}) THEN {n}" for n, kinds in enumerate(retrieval.GROUPS.values(), 1)) + f" ELSE {len(retrieval.GROUPS)} END"
_TITLES = "[" + ", ".join(f"'{t}'" for t in [retrieval.THEMES, *(f"{t}:" for t in retrieval.GROUPS)]) + "]"
_RENDERED = f"""SELECT query_id, array_to_string([x FOR x IN [string_agg(part, chr(10)) FILTER (section = 0), string_agg(part, chr(10) ORDER BY section) FILTER (section > 0)] IF x IS NOT NULL], chr(10) || chr(10)) AS context FROM (
 SELECT query_id, section, ({_TITLES})[section + 1] || chr(10) || string_agg(line, chr(10) ORDER BY n) AS part FROM (SELECT query_id, section, row_number() OVER (PARTITION BY query_id, section ORDER BY place) AS n,
 '- ' || coalesce('[' || strftime(memory_time, '%Y-%m-%d') || '] ', '') || CASE WHEN section = 0 AND length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE coalesce(text, '') END AS line
 FROM (SELECT *, {_GROUPS} AS section FROM {{}})) WHERE n <= 4 GROUP BY 1, 2) GROUP BY 1"""
_TEXTS = "drawer_id", "wing", "memory_type", "memory_time", "text"


@register("placed", _RENDERED.format("placed JOIN (SELECT drawer_id, wing, memory_type, memory_time, text FROM drawers) USING (drawer_id)"))
def rendered_context(s, d):
    rows = recallable(s, d)
    return retrieval.render(retrieval.policy_rank(_fused(s, d), rows, CALLER, 8).join(rows.select(*_TEXTS), "drawer_id"))


# browsing


@register("drawers", "SELECT wing, room, count(*) AS drawers, array_to_string(list_sort(list(drawer_id))[1:3], ',') AS previews, count(*) > 3 AS truncated FROM drawers GROUP BY 1, 2")
def wing_room_rollup(s, d):
    return browse.rollup(views.drawers(s, d))


@register("drawers visible_drawers", "SELECT wing, (SELECT count(*) FROM visible_drawers v WHERE v.wing = d.wing) AS visible, count(*) - (SELECT count(*) FROM visible_drawers v WHERE v.wing = d.wing) AS withheld FROM drawers d GROUP BY wing")
def owner_browse(s, d):
    return browse.owner_browse(views.drawers(s, d), visibility.visible(CALLER))


@register("drawers", "SELECT room, count(*) AS drawers, count(DISTINCT wing) AS wings, count(DISTINCT wing) >= 2 AS tunnel FROM drawers GROUP BY room")
def room_tunnels(s, d):
    return browse.rooms(views.drawers(s, d))


@register("drawers", "SELECT a.room, b.room AS other, count(*) AS shared FROM (SELECT DISTINCT room, wing FROM drawers) a JOIN (SELECT DISTINCT room, wing FROM drawers) b ON a.wing = b.wing AND a.room < b.room GROUP BY 1, 2")
def room_edges(s, d):
    return browse.room_edges(views.drawers(s, d))


@register("visible_drawers", f"SELECT drawer_id, {sql_iso('d.memory_time')} AS memory_time FROM visible_drawers d WHERE d.memory_time < TIMESTAMP '2024-01-20' ORDER BY d.memory_time DESC, drawer_id DESC LIMIT 25")
def entries_page(s, d):
    return browse.entries(recallable(s, d), 25, ("2024-01-20T00:00:00", -1)).select("drawer_id", iso(F.col("memory_time")).alias("memory_time"))


@register("visible_drawers", f"SELECT drawer_id, text, {sql_iso('memory_time')} AS memory_time FROM visible_drawers")
def export_all(s, d):
    return browse.export(views.drawers(s, d), visibility.visible(CALLER)).select("drawer_id", "text", iso(F.col("memory_time")).alias("memory_time"))


@register("", rf"""SELECT doc_id, CAST(score AS DOUBLE) AS score FROM (SELECT doc_id, CASE WHEN t = '{PHRASE}' THEN 1.0 WHEN contains(t, '{PHRASE}') THEN 0.9 WHEN length(t) >= 4 AND contains('{PHRASE}', t) THEN 0.85 END AS score
 FROM (SELECT doc_id, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g') AS t FROM documents)) WHERE score IS NOT NULL""")
def forget_candidates(s, d):
    return browse.forget_candidates(load(s, d, "documents"), PHRASE).select("doc_id", "score")


@register("drawers", """SELECT space_id, audience, wing, drawers, ids, substr(sha256(space_id || '|' || audience || '|' || wing || '|30|' || sorted), 1, 16) AS theme_id FROM (SELECT space_id, audience, wing, count(*) AS drawers, string_agg(drawer_id::VARCHAR, ',' ORDER BY n DESC) FILTER (n <= 30) AS ids,
 string_agg(drawer_id::VARCHAR, ',' ORDER BY drawer_id::VARCHAR) FILTER (n <= 30) AS sorted FROM (SELECT space_id, coalesce(audience, 'owner') AS audience, wing, drawer_id, row_number() OVER (PARTITION BY space_id, coalesce(audience, 'owner'), wing ORDER BY memory_time DESC NULLS LAST, drawer_id DESC) AS n
 FROM drawers WHERE memory_time IS NULL OR memory_time >= TIMESTAMP '2024-01-03') GROUP BY 1, 2, 3) WHERE drawers >= 3""")
def theme_groups(s, d):
    return browse.theme_groups(views.drawers(s, d), graph.time("2024-01-03T00:00:00"), 30, 3, 30)


# ledgers


@register("command_events", """, m AS (SELECT request_id, min(seq) FILTER (status = 'applied') AS a, min(seq) FILTER (status = 'failed') AS f FROM command_events GROUP BY 1)
SELECT e.request_id, CASE WHEN any_value(a) IS NOT NULL THEN 'applied' WHEN any_value(f) IS NOT NULL THEN 'failed' ELSE coalesce(arg_max(e.status, seq) FILTER (status <> 'accepted'), 'accepted') END AS status,
 count(*) FILTER (status <> 'accepted' AND (coalesce(least(a, f), a, f) IS NULL OR seq <= coalesce(least(a, f), a, f) OR seq = a)) AS attempts FROM command_events e JOIN m USING (request_id) GROUP BY 1""")
def command_status_fold(s, d):
    return ledgers.command_status(views.command_events(s, d))


@register("dead_letters", f"SELECT state, count(*) AS entries, sum(payload_bytes)::BIGINT AS bytes, {sql_iso('min(created_at) FILTER (state <> $$resolved$$)')} AS oldest FROM dead_letters GROUP BY state")
def dlq_stats(s, d):
    return ledgers.dead_letter_stats(views.dead_letters(s, d)).withColumn("oldest", iso(F.col("oldest")))


@register("dead_letters", "SELECT entry_id, state, payload_bytes FROM dead_letters WHERE state = 'pending' ORDER BY created_at DESC, entry_id DESC LIMIT 50 OFFSET 50")
def dlq_page(s, d):
    return ledgers.dead_letter_page(views.dead_letters(s, d), "pending", 50, 50).select("entry_id", "state", "payload_bytes")


@register("sync_events", "SELECT seq, event_id, idempotency_hash FROM (SELECT *, row_number() OVER (PARTITION BY idempotency_hash ORDER BY seq) AS m FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq) AS n FROM sync_events) WHERE n = 1) WHERE m = 1")
def sync_dedup(s, d):
    return ledgers.first_deliveries(views.sync_events(s, d)).select("seq", "event_id", "idempotency_hash")


@register("", "SELECT turn_id, version, min(seq) AS seq, arg_min(h, seq) AS input_hash, count(*) FILTER (h <> k) AS conflicts FROM (SELECT *, first_value(h) OVER (PARTITION BY turn_id, version ORDER BY seq) AS k FROM (SELECT 'turn_' || (event_id % 500) AS turn_id, event_id % 3 AS version, event_id AS seq, props AS h FROM events)) GROUP BY 1, 2")
def decision_put_if_absent(s, d):
    n = F.col("event_id")
    rows = load(s, d, "events").select(views.text_of("turn_", n % 500).alias("turn_id"), (n % 3).alias("version"), n.alias("seq"), F.col("props").alias("input_hash"))
    return ledgers.first_decisions(rows)


_FACT_SQL = """, fe AS (SELECT 'fact_' || user_id || '_' || (event_id % 10) AS fact_id, 'slot_' || user_id AS slot, event_id AS seq, CASE event_type WHEN 'view' THEN 'add' WHEN 'click' THEN 'add' WHEN 'purchase' THEN 'invalidate' WHEN 'signup' THEN 'reactivate' ELSE CASE WHEN event_id % 20 = 0 THEN 'forget' ELSE 'add' END END AS kind, props AS evidence FROM events),
facts AS (SELECT fact_id, any_value(slot) AS slot, CASE WHEN bool_or(kind = 'forget') THEN 'forgotten' WHEN arg_max(kind, seq) = 'invalidate' THEN 'invalidated' ELSE 'active' END AS state, count(DISTINCT evidence) FILTER (kind = 'add') AS evidence,
 count(*) FILTER (kind IN ('add', 'reactivate') AND NOT coalesce(before IN ('add', 'reactivate'), false)) AS activations, max(seq) AS last_seq FROM (SELECT *, lag(kind) OVER (PARTITION BY fact_id ORDER BY seq) AS before FROM fe) GROUP BY 1)
"""


def _facts(s, d) -> DataFrame:
    n = F.col("event_id")
    kind = F.when(F.col("event_type").isin("view", "click"), "add").when(F.col("event_type") == "purchase", "invalidate").when(F.col("event_type") == "signup", "reactivate").when(n % 20 == 0, "forget").otherwise("add")
    e = load(s, d, "events").select(views.text_of("fact_", F.col("user_id"), "_", n % 10).alias("fact_id"), views.text_of("slot_", F.col("user_id")).alias("slot"), n.alias("seq"), kind.alias("kind"), F.col("props").alias("evidence"))
    return ledgers.fold_facts(e)


@register("command_events", _FACT_SQL + "SELECT * FROM facts")
def fact_register_fold(s, d):
    return _facts(s, d)


@register("command_events", _FACT_SQL + "SELECT slot, arg_max(fact_id, last_seq) AS fact_id, count(*) - 1 AS conflicts FROM facts WHERE state = 'active' GROUP BY slot")
def fact_active_for_slot(s, d):
    return ledgers.active_for_slot(_facts(s, d))


@register("command_events", _FACT_SQL + "SELECT state, count(*) AS facts, sum(evidence)::BIGINT AS evidence, max(activations) AS most_activations FROM facts GROUP BY state")
def canonical_stats(s, d):
    return _facts(s, d).groupBy("state").agg(F.count("*").alias("facts"), F.sum("evidence").alias("evidence"), F.max("activations").alias("most_activations"))


@register("command_events", """, m AS (SELECT split_part(request_id, '_', 2) AS k, bool_or(status = 'applied') AS a, bool_or(status = 'failed') AS f FROM command_events GROUP BY request_id)
SELECT k AS owner, count(*) FILTER (NOT a AND NOT f) AS pending, count(*) FILTER (NOT a AND f) AS failed, CASE WHEN count(*) FILTER (NOT a AND f) > 0 THEN 'degraded' WHEN count(*) FILTER (NOT a AND NOT f) > 0 THEN 'materializing' ELSE 'ready' END AS state FROM m GROUP BY 1""")
def materialization(s, d):
    rows = ledgers.command_status(views.command_events(s, d)).groupBy(F.split_part("request_id", F.lit("_"), F.lit(2)).alias("owner"))
    out = rows.agg(F.count_if(F.col("status").isin("accepted", "retrying")).alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"))
    return out.withColumn("state", ledgers.materialization(F.col("pending"), F.col("failed")))


_STEP = "CASE WHEN z.status IS NULL THEN CASE WHEN e.status = 'confirmed' THEN 'confirmed' ELSE 'proposed' END WHEN z.status = 'proposed' AND e.status IN ('confirmed', 'cancelled', 'superseded') THEN e.status WHEN z.status = 'confirmed' AND e.status IN ('fulfilled', 'cancelled', 'superseded') THEN e.status ELSE z.status END"
_COMMITMENTS = f"""WITH RECURSIVE {{}}, f AS (
 SELECT commitment_id, promisor, 1 AS n, CASE WHEN status = 'confirmed' THEN status ELSE 'proposed' END AS status, 1 AS revision, 0 AS rejected, [participant] AS participants, due_at FROM commitment_events WHERE n = 1
 UNION ALL SELECT z.commitment_id, z.promisor, e.n, {_STEP}, z.revision + ({_STEP} = e.status)::INT, z.rejected + ({_STEP} <> e.status)::INT, CASE WHEN {_STEP} = e.status THEN list_distinct(list_append(z.participants, e.participant)) ELSE z.participants END,
  CASE WHEN {_STEP} = e.status THEN coalesce(e.due_at, z.due_at) ELSE z.due_at END FROM f z JOIN commitment_events e ON e.commitment_id = z.commitment_id AND e.n = z.n + 1),
commitments AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY commitment_id ORDER BY n DESC) = 1)
"""


def _commitment_sql(select: str) -> str:
    return sql("commitment_events", "").strip().removeprefix("WITH ").join(_COMMITMENTS.split("{}")) + select


@register("", None)
def commitment_fold(s, d):
    out = ledgers.fold_commitments(views.commitment_events(s, d))
    return out.withColumn("participants", F.array_join("participants", ",")).withColumn("due_at", iso(F.col("due_at")))


@register("", None)
def commitment_page(s, d):
    return ledgers.commitment_page(ledgers.fold_commitments(views.commitment_events(s, d)), 100).select("commitment_id", "status", "revision", "total")


ORACLES["commitment_fold"] = _commitment_sql(f"SELECT commitment_id, promisor, status, revision, rejected, array_to_string(list_sort(participants), ',') AS participants, {sql_iso('due_at')} AS due_at FROM commitments")
_LIVE = "status IN ('proposed', 'confirmed')"
ORACLES["commitment_page"] = _commitment_sql(f"SELECT commitment_id, status, revision, (SELECT count(*) FROM commitments) AS total FROM commitments ORDER BY {_LIVE} DESC, CASE WHEN {_LIVE} THEN due_at END ASC NULLS LAST, due_at DESC NULLS LAST, commitment_id LIMIT 100")


@register("commitment_events", "SELECT commitment_id, row_number() OVER (PARTITION BY commitment_id ORDER BY n) AS n, status, participant FROM (SELECT * FROM commitment_events QUALIFY row_number() OVER (PARTITION BY commitment_id ORDER BY n DESC) <= 3)")
def commitment_history(s, d):
    return ledgers.commitment_history(views.commitment_events(s, d), 3).select("commitment_id", "n", "status", "participant")


@register("", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def privacy_anti_join(s, d):
    return ledgers.without_tombstones(load(s, d, "documents"), load(s, d, "labels").where("toxic = 1"), "doc_id").select("doc_id")


def _provisional_sql(most: int, budget: int) -> str:
    """Greedy picks, one query for each."""
    rows = "rows AS (SELECT source AS turn_group, doc_id AS id, strlen(text) AS bytes FROM documents)"
    picks = [f"p1 AS (SELECT turn_group, max(id) AS id, arg_max(bytes, id) AS used FROM rows WHERE bytes <= {budget} GROUP BY 1)"]
    picks += [f"p{n} AS (SELECT turn_group, max(r.id) AS id, used + arg_max(bytes, r.id) AS used FROM rows r JOIN p{n - 1} p USING (turn_group) WHERE r.id < p.id AND bytes + used <= {budget} GROUP BY turn_group, used)" for n in range(2, most + 1)]
    return f"WITH {', '.join([rows, *picks])} " + " UNION ALL ".join(f"SELECT turn_group, id FROM p{n}" for n in range(1, most + 1))


@register("", _provisional_sql(ledgers.PROVISIONAL_ROWS, ledgers.PROVISIONAL_BYTES))
def provisional_budget(s, d):
    rows = load(s, d, "documents").select(F.col("source").alias("turn_group"), F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("bytes"))
    return ledgers.provisional_sources(rows)


@register("statements", "SELECT source_turn_id, count(*) AS proposed, count(*) FILTER (confidence >= 0.6) AS written, count(*) FILTER (confidence < 0.6) AS dropped FROM (SELECT *, row_number() OVER (PARTITION BY source_turn_id ORDER BY recorded_at, statement_id) AS n FROM statements) WHERE n <= 6 GROUP BY 1")
def steward_filter(s, d):
    place = Window.partitionBy("source_turn_id").orderBy("recorded_at", "statement_id")
    some = views.statements(s, d).withColumn("n", F.row_number().over(place)).where("n <= 6")
    return some.groupBy("source_turn_id").agg(F.count("*").alias("proposed"), F.count_if(F.col("confidence") >= 0.6).alias("written"), F.count_if(F.col("confidence") < 0.6).alias("dropped"))


@register("", "SELECT conv_id, turn, sha256(user_text) AS user_sha, sha256(assistant_text) AS assistant_sha FROM (SELECT conv_id, turn, role, text AS user_text, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS assistant_text FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'")
def conversation_turns(s, d):
    return views.turns(s, d).select("conv_id", "turn", F.sha2("user_text", 256).alias("user_sha"), F.sha2("assistant_text", 256).alias("assistant_sha"))


@register("entities", r"SELECT entity_id, replace(replace(lower(trim(name)), ' ', '_'), '''', '') AS slug, 'e_' || substr(sha256(entity_id || chr(31) || name), 1, 24) AS content_id FROM entities")
def entity_ids(s, d):
    return views.entities(s, d).select("entity_id", ids.slug(F.col("name")).alias("slug"), ids.content_id("e_", 24, F.col("entity_id"), F.col("name")).alias("content_id"))


# evaluation


@register("fused", "SELECT count(*) AS queries, round(avg(h / n), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM (SELECT g.query_id, count(f.rank) AS h, count(*) AS n, min(f.rank) AS r FROM (SELECT query_id, drawer_id FROM vector WHERE rank <= 3) g LEFT JOIN (SELECT * FROM fused WHERE rank <= 10) f USING (query_id, drawer_id) GROUP BY 1)")
def retrieval_recall_mrr(s, d):
    gold = retrieval.vector_candidates(recallable(s, d), asked_vectors(s, d), 3).select("query_id", "drawer_id")
    return evaluation.recall_and_mrr(_fused(s, d), gold, 10)


@register("", "SELECT event_type, count(*) AS n, max(value) FILTER (r = greatest(floor(0.5 * c), 1)) AS p50, max(value) FILTER (r = greatest(floor(0.95 * c), 1)) AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS c FROM events) GROUP BY 1")
def percentiles_nearest_rank(s, d):
    return evaluation.nearest_rank(load(s, d, "events"), "event_type", "value", [0.5, 0.95])


@register("statements", """, p AS (SELECT subject_id, predicate, object_id, count(*) AS p FROM statements WHERE confidence >= 0.3 GROUP BY ALL), g AS (SELECT subject_id, predicate, object_id, count(*) AS g FROM statements WHERE audience = 'owner' GROUP BY ALL)
SELECT sum(least(coalesce(p, 0), coalesce(g, 0)))::BIGINT AS matched, sum(p)::BIGINT AS proposed, sum(g)::BIGINT AS gold, round(sum(least(coalesce(p, 0), coalesce(g, 0))) / sum(p), 6) AS precision, round(sum(least(coalesce(p, 0), coalesce(g, 0))) / sum(g), 6) AS recall FROM p FULL JOIN g USING (subject_id, predicate, object_id)""")
def extraction_pr(s, d):
    rows = views.statements(s, d)
    return evaluation.confusion(rows.where("confidence >= 0.3"), rows.where("audience = 'owner'"), ["subject_id", "predicate", "object_id"])


from recallspark.plans import more  # noqa: E402, F401  registers the rest
