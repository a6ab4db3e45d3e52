"""Participants x time bins activity, held as bit words.

A 0/1 matrix of H bins is ``ceil(H / 64)`` bigint columns per participant. They
are built by ``bit_or`` in one hash aggregate: fixed-width buffers, map-side
combine, one row per participant and map task in the shuffle. The dense grid of
participants x bins is never joined or materialised; it is unfolded per row when
a dense form is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def word_count(bins: int) -> int:
    return -(-bins // WORD)


def word_names(bins: int, prefix: str = "w") -> list[str]:
    return [f"{prefix}{index}" for index in range(word_count(bins))]


def _bit(bin_column: Column) -> Column:
    shift = F.pmod(bin_column - F.lit(1), F.lit(WORD)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), shift)


def pack_bins(bin_column: Column, bins: int, condition: Column | None = None, prefix: str = "w") -> list[Column]:
    """Aggregates that set one bit per bin seen (1..bins); bins outside are ignored."""
    columns = []
    for index, name in enumerate(word_names(bins, prefix)):
        test = bin_column.between(index * WORD + 1, min((index + 1) * WORD, bins))
        if condition is not None:
            test = test & condition
        columns.append(F.coalesce(F.bit_or(F.when(test, _bit(bin_column))), F.lit(0).cast("bigint")).alias(name))
    return columns


def count_bits(names: Sequence[str]) -> Column:
    """Number of active bins."""
    total = F.lit(0).cast("bigint")
    for name in names:
        total = total + F.bit_count(name)
    return total


def is_active(names: Sequence[str], bin_column: Column) -> Column:
    """0/1 state of a one-based bin."""
    words = F.array(*[F.col(name) for name in names])
    zero_based = (bin_column - F.lit(1)).cast("int")
    word = F.element_at(words, (F.floor(zero_based / F.lit(WORD)) + F.lit(1)).cast("int"))
    return F.getbit(word, F.pmod(zero_based, F.lit(WORD))).cast("int")


def activity_words(bin_events: DataFrame, bins: int, bin_column: str = "bin", keys: Sequence[str] = ("p_id",)) -> DataFrame:
    """One row per key with the activity words of the bins that occur."""
    return bin_events.groupBy(*keys).agg(*pack_bins(F.col(bin_column), bins))


def all_participants(words: DataFrame, participants: DataFrame) -> DataFrame:
    """Full outer join with the participant list: everybody has words, zero where nothing was seen.

    Keeps people outside the list who have data, as densifying by a full join does.
    """
    joined = words.join(participants.select("p_id"), "p_id", "full")
    return joined.fillna(0, [name for name in words.columns if name != "p_id"])


def activity_grid(words: DataFrame, bins: int, keys: Sequence[str] = ("p_id",)) -> DataFrame:
    """Dense long form ``(keys, bin, active)``, unfolded row by row without a shuffle."""
    names = word_names(bins)
    return words.select(*keys, *names, F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")).select(
        *keys, "bin", is_active(names, F.col("bin")).alias("active")
    )


def active_bins(names: Sequence[str], bins: int) -> Column:
    """``array<int>`` of the active bins."""
    return F.filter(F.sequence(F.lit(1), F.lit(bins)), lambda b: is_active(names, b) == 1)


def activity_vector(names: Sequence[str], bins: int) -> Column:
    """``array<int>`` of 0/1 with one entry per bin."""
    return F.array(
        *[F.getbit(F.col(names[index // WORD]), F.lit(index % WORD)).cast("int") for index in range(bins)]
    )


def activity_wide(words: DataFrame, bins: int, prefix: str = "b") -> DataFrame:
    """One column per bin; a projection of the words, no pivot needed."""
    names = word_names(bins)
    columns = [
        F.getbit(F.col(names[index // WORD]), F.lit(index % WORD)).cast("bigint").alias(f"{prefix}{index + 1}")
        for index in range(bins)
    ]
    return words.select("p_id", *columns)
