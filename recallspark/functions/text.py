"""Wording, times and metadata of memory records, as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: how a statement of each predicate reads ({s} subject, {o} object), what the owner and an inference are called
TEMPLATES = {
    "child_of": "{s} 是 {o} 的孩子",
    "parent_of": "{s} 是 {o} 的父母",
    "partner_of": "{s} 是 {o} 的伴侣",
    "sibling_of": "{s} 是 {o} 的兄弟姐妹",
    "friend_of": "{s} 和 {o} 是朋友",
    "colleague_of": "{s} 和 {o} 是同事",
    "works_at": "{s} 在 {o} 工作",
    "lives_in": "{s} 住在 {o}",
    "studies_at": "{s} 在 {o} 学习",
    "holds_role": "{s} 担任 {o}",
    "born_in": "{s} 出生于 {o}",
    "likes": "{s} 喜欢 {o}",
    "dislikes": "{s} 不喜欢 {o}",
    "prefers": "{s} 偏好 {o}",
    "does": "{s} 做 {o}",
    "practices": "{s} 在练习 {o}",
    "owns": "{s} 拥有 {o}",
    "uses": "{s} 在使用 {o}",
    "promised": "{s} 承诺 {o}",
    "committed_to": "{s} 承诺要 {o}",
    "planned_to": "{s} 计划 {o}",
    "has_state": "{s} 处于状态 {o}",
    "has_emotion": "{s} 感受到 {o}",
    "has_concern": "{s} 担心 {o}",
    "worried_about": "{s} 担心 {o}",
    "struggles_with": "{s} 在困扰于 {o}",
    "has_health_condition": "{s} 患有 {o}",
    "takes_medication": "{s} 在服用 {o}",
    "has_symptom": "{s} 有症状 {o}",
    "attended": "{s} 参加了 {o}",
    "experienced": "{s} 经历了 {o}",
    "achieved": "{s} 达成了 {o}",
}
PET_ROLE, OTHER_ROLE, SELF, INFERRED = "{s} 的品种/身份是 {o}", "{s} 的角色/身份是 {o}", "用户", "（推测）"
# fixed values: metadata that never leaves the store
INTERNAL = ["memory_space_id", "memory_realm_id", "owner_id", "person_id", "identity_epoch", "source_instance_id", "audience", "session_id", "fragment_id", "extensions"]


def entity_label(name: Column) -> Column:
    """What an entity is called: the owner by a word, others without the type before the first colon."""
    kind, label = F.split_part(name, F.lit(":"), F.lit(1)), F.substr(name, F.instr(name, ":") + 1)
    typed = (F.instr(name, ":") > 0) & kind.rlike("^[A-Za-z0-9_]*[A-Za-z0-9][A-Za-z0-9_]*$") & (label != "")
    return F.when(name == "self", F.lit(SELF)).when(typed, label).otherwise(F.coalesce(name, F.lit("")))


def _filled(template: Column | str, subject: Column, object_: Column) -> Column:
    """A template with its two slots filled; fillings are not searched for slots."""
    t = F.lit(template) if isinstance(template, str) else template
    before, rest = F.split_part(t, F.lit("{s}"), F.lit(1)), F.split_part(t, F.lit("{s}"), F.lit(2))
    return F.concat(before, subject, F.split_part(rest, F.lit("{o}"), F.lit(1)), object_, F.split_part(rest, F.lit("{o}"), F.lit(2)))


def fact_sentence(subject: Column, predicate: Column, object_: Column) -> Column:
    """A statement as the sentence that means it; unknown predicates stand between both ends."""
    known = F.create_map(*(F.lit(x) for kv in TEMPLATES.items() for x in kv))
    template = F.coalesce(F.try_element_at(known, predicate), F.concat(F.lit("{s} "), predicate, F.lit(" {o}")))
    template = F.when(predicate == "holds_role", F.when(F.startswith(subject, F.lit("pet:")), F.lit(PET_ROLE)).otherwise(F.lit(OTHER_ROLE))).otherwise(template)
    return _filled(template, entity_label(subject), entity_label(object_))


def _when(t: Column) -> Column:
    """A time to the minute, one at midnight as its day, none as empty."""
    day = F.date_format(t, "yyyy-MM-dd")
    return F.when(t.isNull(), F.lit("")).when(F.date_format(t, "HH:mm:ss") == "00:00:00", day).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm"))


def transcribed(subject: Column, predicate: Column, object_: Column, valid_from: Column, valid_to: Column, recorded_at: Column) -> Column:
    """A statement as one line: marked as inferred, with its validity, and the month it was heard where that says more."""
    begin, end = _when(valid_from), _when(valid_to)
    heard = F.coalesce(F.date_format(recorded_at, "yyyy-MM"), F.lit(""))
    held = F.when((predicate == "promised") & (end != ""), F.concat(F.lit("截至 "), end))
    held = held.when(end != "", F.concat(F.when(begin != "", begin).otherwise(F.lit("？")), F.lit(" → "), end, F.lit("，已结束"))).when(begin != "", F.concat(F.lit("自 "), begin))
    source = F.when((heard != "") & (heard != F.substring(begin, 1, 7)), F.concat(F.lit("根据 "), heard, F.lit(" 的对话")))
    parts = F.array_compact(F.array(held, source))
    tail = F.when(F.size(parts) > 0, F.concat(F.lit("（"), F.array_join(parts, "；"), F.lit("）"))).otherwise(F.lit(""))
    return F.concat(F.lit(INFERRED), fact_sentence(subject, predicate, object_), tail)


def canonical_time(text: Column) -> Column:
    """ISO-8601 text as UTC text with microseconds; a day as its midnight without them; what cannot be read stays as it is; blank is null."""
    value = F.trim(text)
    day = F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_timestamp(value).isNotNull(), F.concat(value, F.lit("T00:00:00Z")))
    instant = F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return F.when(value != "", F.coalesce(day, instant, value))


#: Where a record's time comes from, best first.
TIME_SOURCES = ["memory_time", "occurred_at", "valid_from", "created_at", "filed_at", "updated_at"]


def memory_time(fields: dict[str, Column]) -> tuple[Column, Column]:
    """The first readable time of a record by TIME_SOURCES, and the source's name; fields may lack some."""
    read = {n: F.try_to_timestamp(fields[n]) for n in TIME_SOURCES if n in fields}
    name = F.coalesce(*(F.when(t.isNotNull(), F.lit(n)) for n, t in read.items()))
    return F.coalesce(*read.values()), name


def provenance(metadata: Column) -> Column:
    """learned_at, last_modified_at, occurred_at and source_quote of a metadata map; a modification counts if explicit or later than the learning."""
    get = lambda k: F.try_element_at(metadata, F.lit(k))
    at = lambda k: F.try_to_timestamp(get(k))
    learned, explicit, touched = at("indexed_at"), at("updated_at"), at("last_modified")
    modified = F.when(explicit.isNotNull(), explicit).when(touched > learned, touched)
    return F.struct(learned.alias("learned_at"), modified.alias("last_modified_at"), at("occurred_at").alias("occurred_at"), F.coalesce(get("evidence_quote"), F.lit("")).alias("source_quote"))


def squeezed(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def room_token(text: Column, prefix: str = "topic") -> Column:
    """A room key from text: letters, digits and underscores in lower case, 48 characters at most."""
    clean = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_]+", "_")
    clean = F.regexp_replace(F.regexp_replace(clean, "_+", "_"), "^_|_$", "")
    return F.concat(F.lit(f"{prefix}_"), F.when(clean == "", F.lit("general")).otherwise(F.substring(clean, 1, 48)))


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC and case folding, blanks squeezed; Spark has no built-in for either."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def drawer_id(wing: Column, room: Column, content: Column) -> Column:
    return F.concat_ws("_", F.lit("drawer"), wing, room, F.substring(F.sha2(F.concat(wing, room, content), 256), 1, 24))


def fragment_id(space: Column, turn: Column, index: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\n", space, turn, index.cast("string"), squeezed(content)), 256)


def projection_id(assertion: Column, activations: Column) -> Column:
    """The assertion's id, with its activation from the second on."""
    return F.when(activations <= 1, assertion).otherwise(F.concat(assertion, F.lit(":activation:"), activations.cast("string")))


def unit(vector: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def hash_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic vector of a text for tests: each word adds a signed weight at a place, all three from its SHA-256."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    words = F.when(F.size(words) > 0, words).otherwise(F.array(F.coalesce(text, F.lit(""))))
    byte = lambda d, k: F.conv(F.substring(d, 2 * k + 1, 2), 16, 10).cast("int")
    digests = F.transform(words, lambda w: F.sha2(w, 256))
    marks = F.transform(digests, lambda d: F.struct((byte(d, 0) % size).alias("at"), (F.when(byte(d, 1) % 2 == 0, 1.0).otherwise(-1.0) * (1 + byte(d, 2) / 255.0)).alias("x")))
    places = F.sequence(F.lit(0), F.lit(size - 1))
    return unit(F.transform(places, lambda k: F.aggregate(F.filter(marks, lambda m: m["at"] == k), F.lit(0.0), lambda s, m: s + m["x"])))


_NAMESPACES = "map<string,map<string,string>>"


def extensions(raw: Column) -> Column:
    """The usable extensions of JSON text: objects under names of lower-case letters, digits and underscores; null or unreadable text has none."""
    parsed = F.try_parse_json(raw)
    pairs = F.from_json(raw, "map<string,string>")
    usable = F.map_filter(pairs, lambda k, v: k.rlike("^[a-z][a-z0-9_]{0,63}$") & F.startswith(F.trim(v), F.lit("{")))
    nested = F.transform_values(usable, lambda k, v: F.from_json(v, "map<string,string>"))
    empty = F.from_json(F.lit("{}"), _NAMESPACES)
    return F.when(parsed.isNull(), empty).otherwise(F.coalesce(nested, empty))


def location_boost(found: Column, query: Column) -> Column:
    """0.12 if the room of a record's location extension is named in the query."""
    room = F.try_element_at(F.try_element_at(found, F.lit("location")), F.lit("room"))
    return F.when(F.coalesce((room != "") & F.contains(query, room), F.lit(False)), F.lit(0.12)).otherwise(F.lit(0.0))


#: Extension policies by namespace: (extensions, query) -> boost.
POLICIES: dict[str, Callable[[Column, Column], Column]] = {"location": location_boost}


def register_policy(namespace: str, policy: Callable[[Column, Column], Column]) -> None:
    """Adds or replaces the recall policy of an extension namespace."""
    POLICIES[namespace] = policy


def boosts(found: Column, query: Column) -> Column:
    """The sum of all registered policies' boosts for extensions that a record has."""
    total = F.lit(0.0)
    for namespace, policy in sorted(POLICIES.items()):
        total = total + F.when(F.coalesce(F.map_contains_key(found, namespace), F.lit(False)), policy(found, query)).otherwise(F.lit(0.0))
    return total


def clean_list(values: Column) -> Column:
    """Trimmed, distinct, sorted, without empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")))


def public_metadata(metadata: Column) -> Column:
    """A metadata map without private (underscore) and internal keys."""
    return F.map_filter(metadata, lambda k, _: ~F.startswith(k, F.lit("_")) & ~k.isin(INTERNAL))


def cursor(*parts: Column) -> Column:
    """An opaque page cursor: URL-safe base64 of a JSON array, without padding."""
    text = F.to_json(F.array(*(p.cast("string") for p in parts)))
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def cursor_parts(token: Column) -> Column:
    """The strings in a cursor; null if it is no cursor or over 1,024 characters."""
    raw = F.concat(F.translate(token, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.char_length(token), F.lit(4))))
    return F.when(F.char_length(token) <= 1024, F.from_json(F.try_to_binary(raw, F.lit("base64")).cast("string"), "array<string>"))


def first_object(reply: Column) -> Column:
    """The first JSON object in a model's reply, within a fence or not; null if none can be read."""
    body = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    body = F.when(body != "", body).otherwise(F.regexp_extract(reply, r"(?s)(\{.*\})", 1))
    return F.when((body != "") & F.try_parse_json(body).isNotNull(), body)


def subject_token(space: Column) -> Column:
    """A space's name in a message subject."""
    return F.concat(F.lit("b64_"), F.rtrim(F.translate(F.base64(F.encode(space, "UTF-8")), "+/", "-_"), F.lit("=")))


def safe_name(value: Column, most: int = 180) -> Column:
    """A name of letters, digits, underscores and hyphens; runs of others become one underscore, none is left at the ends, nothing is `default`, and what is too long ends in a hash of the whole.

    The head of a long text mostly is too long a name already; only where it is not is the whole cleaned.
    """
    raw = F.trim(F.coalesce(value, F.lit("")))
    clean = lambda t: F.regexp_replace(F.regexp_replace(t, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")
    cut = lambda t: F.concat(F.substring(t, 1, max(1, most - 17)), F.lit("_"), F.substring(F.sha2(raw, 256), 1, 16))
    head, safe = clean(F.substring(raw, 1, 4 * most)), clean(raw)
    return F.when(F.char_length(head) > most, cut(head)).when(F.char_length(safe) > most, cut(safe)).when(safe == "", F.lit("default")).otherwise(safe)


def pooled(hidden: Column, mask: Column, kind: str = "mean") -> Column:
    """One vector of the vectors of a text's tokens: the first (cls), or the mean of those whose mask is 1, of length one; no tokens have none."""
    kept = F.transform(F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["h"])
    size = F.size(kept)
    mean = F.transform(F.sequence(F.lit(1), F.size(hidden[0])), lambda k: F.aggregate(kept, F.lit(0.0), lambda s, v: s + F.element_at(v, k).cast("double")) / size)
    return F.when(F.size(hidden) > 0, unit(hidden[0]) if kind == "cls" else F.when(size > 0, unit(mean)))
