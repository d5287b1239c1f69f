"""Array formulas for a block of cells against a block of stations."""

import math

import numpy as np
import pandas as pd

from ridgeline import params as P


VALUES = ("ws", "u", "v", "elev")
SUMS = tuple(f"{k}_{where}" for where in ("far", "here") for k in ("n", *VALUES))


def weighted_sums(cells: pd.DataFrame, net: pd.DataFrame, shrink: float) -> pd.DataFrame:
    """Inverse-distance weights (n_far) and weighted sums of cells over stations, the vertical counted many times; stations at a cell's
    own place are counted and summed apart (_here)."""
    degree_m = math.pi / 180.0 * P.EARTH_RADIUS_M
    lat, lon, elev = (cells[c].to_numpy(float) for c in ("latitude", "longitude", "elevation"))
    sums = {k: np.zeros(len(cells)) for k in SUMS}
    for s in net.sort_values("station_id").itertuples():
        dy = (s.lat - lat) * degree_m
        dx = (s.lon - lon) * degree_m * shrink
        dz = (s.elev - elev) * P.IDW_VERTICAL_SCALE
        square = dx * dx + dy * dy + dz * dz
        same = square < P.IDW_ZERO_M ** 2
        far = np.where(same, 0.0, np.power(np.where(same, 1.0, square), -P.IDW_POWER / 2))
        for where, factor in (("far", far), ("here", same.astype(float))):
            sums[f"n_{where}"] += factor
            for k in VALUES:
                sums[f"{k}_{where}"] += factor * getattr(s, k)
    return pd.DataFrame({"cell_id": cells["cell_id"].to_numpy(), **sums})
