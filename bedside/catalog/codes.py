"""Item codes that the derived clinical tables carry, one per value 0..99 of the events' ``k`` property."""

from __future__ import annotations

from itertools import chain, cycle, islice

from bedside.specs import fluids
from bedside.specs.measurements import CREATININE, LAB_CODES, OLD_LAB_CODES, OLD_LAB_TEXT_CODES, VITALS


def _hundred(codes: list[int], filler: list[int]) -> list[int]:
    return list(islice(chain(codes, cycle(filler)), 100))


_vitals = [code for measures in VITALS.values() for m in measures for code in m.codes]
_weights = [*fluids.ADMIT_WEIGHT, *fluids.DAILY_WEIGHT]
_gcs = [code for pair in fluids.GCS_CODES.values() for code in pair]
_size = [c for c in (*fluids.WEIGHT_FACTORS, *fluids.HEIGHT_FACTORS) if c not in _weights]

CHART = _hundred([*_vitals, 6, *_weights, *_size, 226531, *_gcs, *fluids.CPAP_CODES], [*_weights, *_gcs, 211, 455])
LABS = _hundred(
    sorted({*LAB_CODES.values(), *OLD_LAB_CODES.values(), *OLD_LAB_TEXT_CODES.values()}), [CREATININE]
)
VASOPRESSORS = _hundred([30047, 30120, 42273, 40055], [30047, 30120, 30044, 42273])
