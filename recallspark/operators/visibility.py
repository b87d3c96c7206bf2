"""Who may see a record: one boolean column, pushed below every top-k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Caller:
    """The context of a read."""

    space_id: str
    audiences: tuple[str, ...] = ("owner",)
    session_id: str | None = None
    person_id: str | None = None
    device_id: str | None = None
    include_private: bool = False
    every_audience: bool = False
    layers: tuple[str, ...] | None = None
    owner_shared_only: bool = False


def same(column: str, value: str | None) -> Column:
    return F.coalesce(F.col(column) == value, F.lit(False)) if value else F.lit(False)


def at_device(caller: Caller) -> Column:
    """Whether a record comes from the caller's device or is meant for it."""
    return same("source_device_id", caller.device_id) | same("target_device_id", caller.device_id)


def visible(caller: Caller) -> Column:
    """Privacy wing, layer, privacy, space, session, person, audience and device rules; whatever is missing fails closed.

    A record without an audience belongs to the owner. The owner's own copy (every_audience) skips session, person and audience.
    """
    privacy = F.lower(F.coalesce("privacy", F.lit("")))
    rules = [F.coalesce(F.col("wing") != "Wing_Privacy", F.lit(True)), F.col("space_id") == caller.space_id, privacy != "do_not_recall"]
    if caller.layers is not None:
        rules.append(F.coalesce(F.col("layer").isin(list(caller.layers)), F.lit(False)))
    if not caller.include_private:
        rules += [privacy != "private", F.coalesce(F.col("visibility") != "private", F.lit(True))]
    if caller.owner_shared_only:
        rules.append(F.coalesce("audience", F.lit("owner")) == "owner")
    if not caller.every_audience:
        rules.append(F.coalesce(F.col("scope") != "session", F.lit(True)) | same("session_id", caller.session_id))
        rules.append(F.col("person_id").isNull() | (F.col("person_id") == "") | same("person_id", caller.person_id))
        rules.append(F.coalesce("audience", F.lit("owner")).isin(list(caller.audiences)) if caller.audiences else F.lit(False))
    rules.append(F.coalesce(F.col("visibility") != "current_device", F.lit(True)) | at_device(caller))
    out = rules[0]
    for r in rules[1:]:
        out = out & r
    return out


def tier(caller: Caller) -> Column:
    """How near a record's scope is to the caller."""
    scope = F.coalesce("scope", F.lit("persona"))
    here = (scope == "device") & at_device(caller)
    # fixed values: the tiers of scopes
    return F.when(here, 0.9).when(scope.isin("global", "persona"), 0.75).when(scope == "agent", 0.7).when(scope == "device", 0.25).otherwise(0.5)


def rendered(caller: Caller) -> Column:
    """Visible, and records of device scope only on their device."""
    return visible(caller) & (F.coalesce(F.col("scope") != "device", F.lit(True)) | at_device(caller))


def reachable(device_id: str | None) -> Column:
    """What a store may leave out before its top-k: records bound to a device that is not the caller's; null visibility stays."""
    elsewhere = F.coalesce(F.col("visibility") == "current_device", F.lit(False))
    return ~elsewhere | same("source_device_id", device_id) | same("target_device_id", device_id)


def stored(wings: list[str], room: str | None = None, audiences: list[str] | None = None, device_id: str | None = None, layers: list[str] | None = None) -> Column:
    """The pre-filter of a search: wings, room, audiences with their device rule, layers; whatever is not given does not filter."""
    rules = []
    if wings:
        rules.append(F.col("wing").isin(wings))
    if room:
        rules.append(F.col("room") == room)
    if audiences is not None:
        rules += [F.coalesce("audience", F.lit("owner")).isin(audiences) if audiences else F.lit(False), reachable(device_id)]
    if layers is not None:
        rules.append(F.coalesce(F.col("layer").isin(layers), F.lit(False)) if layers else F.lit(False))
    out = F.lit(True)
    for r in rules:
        out = out & r
    return out


def recallable(blocked: list[str] | None = None) -> Column:
    """The store's own policy: no privacy wing, nothing private, no room whose status is taboo or archived."""
    status = F.lower(F.coalesce("room_status", F.lit("")))
    private = F.lower(F.coalesce("privacy", F.lit(""))).isin("private", "do_not_recall")
    return F.coalesce(F.col("wing") != "Wing_Privacy", F.lit(True)) & ~private & ~status.isin(["taboo", "archived"] if blocked is None else blocked)


def listed(include_privacy: bool = False) -> Column:
    """Listings hide the privacy wing unless asked."""
    return F.lit(True) if include_privacy else F.coalesce(F.col("wing") != "Wing_Privacy", F.lit(True))


def searched_wings(wing: str | None, wings: list[str]) -> list[str]:
    """One wing if named, else all but privacy and themes."""
    return [wing] if wing else [w for w in wings if w not in ("Wing_Privacy", "Wing_Theme")]
