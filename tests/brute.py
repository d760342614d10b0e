"""Plain Python statements of what the operators compute, for small designs."""

from itertools import product

import numpy as np


def cells_of(spec, profile_id):
    active = spec.active_factors(profile_id)
    axes = [range(1, r) if i in active else [0] for i, r in enumerate(spec.levels)]
    return list(product(*axes))


def policy_id(spec, cell):
    return sum(l * s for l, s in zip(cell, spec.strides))


def segment(spec, i, level, mask):
    """Count the cuts below the level."""
    bits = mask >> spec.offsets[i]
    return sum(1 for j in range(min(max(level - 1, 0), spec.bits[i])) if bits >> j & 1)


def pool_of(spec, cell, mask):
    return tuple(segment(spec, i, l, mask) for i, l in enumerate(cell))


def masks_of(spec, profile_id):
    active = [i for i in spec.active_factors(profile_id) if spec.bits[i]]
    for choice in product(*[range(1 << spec.bits[i]) for i in active]):
        yield sum(m << spec.offsets[i] for i, m in zip(active, choice))


def pools_of(spec, profile_id, mask):
    pools = {}
    for cell in cells_of(spec, profile_id):
        pools.setdefault(pool_of(spec, cell, mask), []).append(cell)
    return list(pools.values())


def loss(spec, rows, profile_id, mask, reg, total):
    """rows: list of (cell, y)."""
    sse = 0.0
    pools = pools_of(spec, profile_id, mask)
    for pool in pools:
        ys = np.array([y for c, y in rows if c in set(pool)])
        if len(ys):
            sse += ((ys - ys.mean()) ** 2).sum()
    return sse / total + reg * len(pools), len(pools)
