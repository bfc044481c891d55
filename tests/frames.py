"""Small hand-made inputs."""

import numpy as np


def sparse_frame(spark, x, label, cluster=None, extra=None):
    """samples rows from a dense array; zeros are left out."""
    rows = []
    for i, v in enumerate(np.asarray(x, dtype=float)):
        at = np.flatnonzero(v)
        rows.append((i, float(label[i]), [int(j) for j in at], [float(v[j]) for j in at], int(cluster[i]) if cluster is not None else 0, 0))
    return spark.createDataFrame(rows, "row_id bigint, label double, idx array<int>, val array<double>, cluster_id int, copy int")


def blobs(n=120, classes=3, seed=1, spread=0.4):
    rng = np.random.default_rng(seed)
    centre = np.array([[0, 0], [4, 0], [0, 4], [4, 4]])[:classes]
    label = np.arange(n) % classes
    return centre[label] + spread * rng.standard_normal((n, 2)), label


def params(spark, clusters, trials):
    rows = [(c, t, p.get("kernel", "linear"), p.get("c", 1.0), p.get("gamma"), p.get("epsilon", 0.1)) for c in clusters for t, p in enumerate(trials)]
    return spark.createDataFrame(rows, "cluster_id int, trial int, kernel string, c double, gamma double, epsilon double")
