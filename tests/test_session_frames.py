"""Moving cameras score every frame and tiles of every level."""

import pytest

from tessera.plans import catalog
from tessera.plans.fixtures import TILE_TABLE, table, view

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["d2_session_priorities", "d4_session_preparation"])
def test_all_frames_and_levels_have_rows(spark, name):
    rows = catalog.queries()[name](spark, SF_DIR).join(view(spark, SF_DIR, TILE_TABLE).select("tile_id", "depth"), "tile_id")
    assert {r.depth for r in rows.select("depth").distinct().collect()} == {0, 1, 2, 3, 4}
    assert rows.select("event_id").distinct().count() == table(spark, SF_DIR, "events").count()
    assert rows.count() == rows.select("event_id", "tile_id").distinct().count()
