import numpy as np
import pytest

from tidemark.llm.whitening import leading, project


@pytest.mark.parametrize("rank", (1, 3))
def test_eigenvalues_at_rounding_level_are_no_components(spark, rank):
    matrix = np.diag([1000.0 / (i + 1) if i < rank else 0.0 for i in range(6)])
    values, vectors = leading(matrix, 32, lambda m, bases, spans: project(spark, m, bases, spans))
    assert values == pytest.approx(np.diag(matrix)[:rank]) and vectors.shape == (6, rank)
