"""Sets of channels as bit masks: two numbers of 64 bits, whatever the number of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = 128  # ids from 0 on that have a bit; electrodes are named 12 to 87


def channel_masks(channel: str = "channel_id") -> tuple[Column, Column]:
    """Two aggregates: the bits of the ids up to 63 and from 64 on, null without such an id.

    A missing id has no bit; one that is too large is an error. The buffers have a fixed size, so the
    aggregation stays a hash aggregation in generated code.
    """
    id_ = F.col(channel)
    message = F.concat(F.lit(f"channel ids go from 0 to {CHANNELS - 1}, this is "), id_.cast("string"))
    known = F.when(id_.between(0, CHANNELS - 1), id_).when(id_.isNotNull(), F.raise_error(message).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), known % 64)
    return F.bit_or(F.when(known < 64, bit)), F.bit_or(F.when(known >= 64, bit))


def channels_n(channel: str = "channel_id") -> Column:
    """Aggregate: the number of distinct channels. A missing id does not count."""
    low, high = channel_masks(channel)
    return members_n(low) + members_n(high)


def members_n(mask: Column) -> Column:
    return F.coalesce(F.bit_count(mask), F.lit(0))


def members(low: int | None, high: int | None) -> tuple[int, ...]:
    """The ids whose bits are set, in order."""
    return tuple(i for i in range(CHANNELS) if ((low, high)[i // 64] or 0) >> i % 64 & 1)
