import copy

import pytest

from quillstone.plans import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["prior_matched", "shape_matched"])
def test_countries_without_a_validation_part(spark, name):
    """Where every block is too large for the validation part, the thresholds are still fitted to the labelled countries."""
    c = copy.copy(registry.context(spark, SF))
    c.val = c.val.limit(0)
    compare(getattr(registry, name)(c), registry.oracle_sql()[name], SF)
