"""The solvers' queries return solutions, or raise."""

import numpy as np
import pytest

from trellis.operators import solvers
from trellis.operators import stencil as S
from trellis.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, sign", [("conjugate_gradients", -1), ("bicgstab", 1)])
def test_residual(spark, name, sign):
    rows = registry.QUERIES[name](spark, SF).toPandas()
    u, b = np.zeros(registry.LINES.n), np.zeros(registry.LINES.n)
    u[rows.x, rows.y, rows.z], b[rows.x, rows.y, rows.z] = rows.u, rows.b
    assert len(rows) == u.size and np.linalg.norm(b) > 0
    assert np.linalg.norm(b - S.laplace(2).scaled(sign).numpy(u)) <= 2e-6 * np.linalg.norm(b)


def test_unsolved_raises(spark):
    op = S.laplace(2).scaled(-1)
    found = solvers.cg(registry._centred(spark, SF), registry.LINES, op, "u", "b", 0.0, 4, relative=1e-6)
    with pytest.raises(ArithmeticError):
        solvers.solved(found, registry.LINES, op, "u", "b", 1e-6)
