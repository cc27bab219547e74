"""Tags of records: ARRAY<STRUCT<tag_type BIGINT, tag_value BINARY>>, in order; the first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the record format.
KIND_TAG = 0
EXPIRATION_TAG = 0x00010001
PARAMETER_TAG = 0x00010002
ROUTING_FLAG = 1 << 5
DEFAULT_KIND = 1


def big_endian(value: Column) -> Column:
    """Unsigned integer of up to 7 bytes (8 with a clear top bit) as BIGINT."""
    return F.conv(F.hex(value), 16, 10).cast("bigint")


def values_of(tags: Column, tag: int) -> Column:
    """Values of all tags of a type, in order."""
    return F.transform(F.filter(tags, lambda t: t["tag_type"] == tag), lambda t: t["tag_value"])


def first_value(tags: Column, tag: int) -> Column:
    return F.try_element_at(values_of(tags, tag), F.lit(1))


def has_tag(tags: Column, tag: int) -> Column:
    return F.coalesce(F.exists(tags, lambda t: t["tag_type"] == tag), F.lit(False))


def kind_tag(tags: Column) -> Column:
    """The first usable kind tag: four bytes, or none for kind 0; other lengths are skipped."""
    usable = F.filter(values_of(tags, KIND_TAG), lambda v: F.octet_length(v).isin(0, 4))
    value = F.try_element_at(usable, F.lit(1))
    return F.when(F.octet_length(value) == 0, F.lit(0).cast("bigint")).otherwise(big_endian(value))


def kind(tags: Column, header_tag: Column) -> Column:
    """Kind tag, else a header tag that isn't 0, else the default."""
    return F.coalesce(kind_tag(tags), F.when(header_tag != 0, header_tag.cast("bigint")), F.lit(DEFAULT_KIND).cast("bigint"))


def parameter(tags: Column) -> Column:
    return first_value(tags, PARAMETER_TAG)


def expiration(tags: Column) -> Column:
    """The first expiration of eight or four bytes."""
    usable = F.filter(values_of(tags, EXPIRATION_TAG), lambda v: F.octet_length(v).isin(4, 8))
    return big_endian(F.try_element_at(usable, F.lit(1)))


def has_flag(mask: Column, flag: int) -> Column:
    return mask.bitwiseAND(flag) == flag


def set_flag(mask: Column, flag: int) -> Column:
    return mask.bitwiseOR(flag)


def clear_flag(mask: Column, flag: int) -> Column:
    return mask.bitwiseAND(~flag)


def sender_key(header_key: Column, sender_id: Column) -> Column:
    """The header's key, else 16 bytes of the sender, else zeros."""
    short = F.substring(sender_id, 1, 16)
    return F.coalesce(header_key, F.when(F.octet_length(sender_id) >= 16, short), F.unhex(F.lit("00" * 16)))
