"""Fills of holes too wide for a relaxation to settle."""

import numpy as np
import pytest

from gridloom.operators import holes


@pytest.mark.parametrize("method", "sm")
@pytest.mark.parametrize("tension", [0.0, 0.4, 1.0])
def test_wide_hole_in_a_tilted_plane(method, tension):
    y, x = np.mgrid[0:46, 0:50].astype(float)
    want = 3 + y + 0.5 * x
    z = want.copy()
    z[3:43, 5:45] = np.nan
    assert np.abs(holes.fill_plane(z, 1, 1, method, tension) - want).max() < 1e-6


def test_hole_beside_an_edge_and_another_hole():
    """The equations hold at every node of an uneven hole, with planes going on oddly beyond their edges."""
    rng = np.random.default_rng(4)
    z = rng.normal(size=(9, 14))
    z[1:4, 1:6] = z[4, 2] = z[5:8, 9:13] = z[0, 8] = np.nan
    got = holes.fill_plane(z, 1, 1, "m", 0.3)
    wide = np.pad(np.where(np.isnan(got), np.nanmean(z), got), 2, mode="reflect", reflect_type="odd")
    for i, j in np.argwhere(holes.label_holes(z) > 0):
        s = lambda a, b: wide[2 + i + a, 2 + j + b]  # noqa: B023, E731
        near, diag = s(1, 0) + s(-1, 0) + s(0, 1) + s(0, -1), s(1, 1) + s(1, -1) + s(-1, 1) + s(-1, -1)
        far = s(2, 0) + s(-2, 0) + s(0, 2) + s(0, -2)
        assert 0.7 * (20 * s(0, 0) - 8 * near + 2 * diag + far) + 0.3 * (4 * s(0, 0) - near) == pytest.approx(0, abs=1e-8)
