"""Column functions on message fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Field names accepted for sender, text and id, in order of preference.
NAME_KEYS = ("client-name", "client_name", "clientName", "clientname", "client", "name", "user", "username", "from", "sender")
TEXT_KEYS = ("msg", "message", "text", "body", "content", "m")
ID_KEYS = ("id", "msg-id", "msg_id", "msgId", "message-id", "message_id", "messageId", "uuid")
ID_PATTERN = "^[A-Za-z0-9._:-]{8,80}$"
KNOWN_KEYS = ("id", "seq", "room", "from", "ts", "kind", "text", "env", "via")


def first_of(fields: Column, keys: Sequence[str]) -> Column:
    """First non-empty value of a ``map<string,string>`` under any of ``keys``."""
    return F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(k)), F.lit("")) for k in keys])


def normalise_id(raw: Column) -> Column:
    """A well-formed id stays; anything else becomes a stable hash; empty stays null."""
    hashed = F.concat(F.lit("cid-"), F.substring(F.sha2(raw, 256), 1, 40))
    return F.when(F.nullif(raw, F.lit("")).isNotNull(), F.when(raw.rlike(ID_PATTERN), raw).otherwise(hashed))


def clean_name(raw: Column, most: int | None = None) -> Column:
    """Sender without control characters, never empty; cut to ``most`` characters where that is given."""
    s = F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\x00-\x1f\x7f]", "")
    s = s if most is None else F.substring(s, 1, most)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("anonymous"))


def extra_fields(entry: Column) -> Column:
    """JSON of the fields outside the known ones; null when there are none."""
    rest = F.map_filter(entry, lambda k, _: ~k.isin(*KNOWN_KEYS))
    return F.when(F.size(rest) > 0, F.to_json(rest))


def shape_entry(kind: Column, text: Column, env: Column, extra: Column) -> Column:
    """``struct<text,env,extra>``: the envelope of encrypted entries, the text of the others."""
    as_map = F.from_json(extra, "map<string,string>")
    return F.struct(
        F.when(kind != "enc", text).alias("text"),
        F.when(kind == "enc", F.from_json(env, "map<string,string>")).alias("env"),
        as_map.alias("extra"),
    )
