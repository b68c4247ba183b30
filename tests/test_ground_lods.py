"""Ground under points by the finest of several meshes, small and wide."""

from tessera.plans.spatial_queries import finest_hits


def test_finest_mesh_of_several_sizes(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 3.5, 2.0), (3, 9.0, 9.0), (4, 4.0, 4.0), (5, -70.0, 3.0)], "event_id long, px double, pz double")
    meshes = [(10, 0.0, 1.0, 4.5, 5.5, 0.0, 1.0, 5.0), (1, 0.0, 4.0, 1.0, 7.0, 0.0, 4.0, 2.0), (2, -100.0, 8.0, 0.0, 2.0, -50.0, 8.0, 1.0), (0, -1000.0, 1000.0, -2000.0, 2000.0, -1000.0, 1000.0, 9.0)]
    meshes = spark.createDataFrame(meshes, "mesh_id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double, y double")
    got = {r.event_id: (r.mesh_id, r.height, r.volume) for r in finest_hits(points, meshes).collect()}
    assert got == {1: (10, 5.0, 0.125), 2: (1, 2.0, 12.0), 4: (1, 2.0, 12.0), 5: (2, 1.0, 1566.0)}  # mesh 0 has half-extents of 2e9
