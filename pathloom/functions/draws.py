"""Seeded numbers as column expressions, for results that must be the same wherever they are drawn."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the step of the generator's 32-bit state.
STEP = 0x6D2B79F5
_WORD = 0xFFFFFFFF


def _word(c: Column) -> Column:
    return c.bitwiseAND(F.lit(_WORD))


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two 32-bit numbers; halves of ``a`` keep it within a long."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16)
    return _word(low * b + (high * b).bitwiseAND(F.lit(0xFFFF)) * 65536)


def seeded(seed: Column, k: Column) -> Column:
    """The ``k``-th number, from 1 on, in [0, 1) of a 32-bit mixing generator; seed 0 counts as 1.

    Its state grows by a fixed step, so a number needs none of those before it.
    """
    start = _word(seed.cast("long"))
    state = _word(F.when(start == 0, 1).otherwise(start) + _times(_word(k.cast("long")), F.lit(STEP)))
    t = _times(state.bitwiseXOR(F.shiftright(state, 15)), state.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR(_word(t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))))
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)
