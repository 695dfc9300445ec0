"""Random numbers from hashes: the same for a row however the table is partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, tag: str, *keys: Column | str) -> Column:
    """A number in [0, 1) from md5 of seed, tag and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def gaussian(seed: int, tag: str, *keys: Column | str) -> Column:
    """A standard normal number by Box and Muller."""
    u, v = uniform(seed, f"{tag}_u", *keys), uniform(seed, f"{tag}_v", *keys)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * F.lit(3.141592653589793) * v)


def fnv_unit(text: Column) -> Column:
    """A number from 0 to 1 from the 32-bit FNV-1a hash of a text's characters (of up to 16 bits each)."""
    # Offset and prime of FNV-1a.
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("long"))) * F.lit(16777619)).bitwiseAND(F.lit((1 << 32) - 1))
    letters = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return F.aggregate(letters, F.lit(2166136261), step) / float((1 << 32) - 1)
