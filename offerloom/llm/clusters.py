"""Centroid clustering by Lloyd's rounds with Elkan's bounds, on whole numbers.

Each vector keeps the centroid it has, an upper bound of its distance to that one, and a lower bound of its distance to each of the k
centroids. They lie in the vector's block (``vectors``), which every round reads and writes again in the shared folder, so a lost executor costs no
more than its tasks of that round. A round moves the bounds by how far the centroids went, and a distance is worked out only
where neither the lower bound nor half the distance between the two centroids proves it larger.

Results are exact: distances are 64-bit integers; bounds are 32-bit floats rounded outwards (upper ones up, lower ones down); a
centroid is skipped only if it is strictly farther, so a tie is always seen and goes to the smaller number. Each
block also holds its sums by cluster, so a round's centroids come from one small sum by Spark; k x dims numbers pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .vectors import blocks_of, main_length, unpack

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, "3"

STATE = "n int, wide int, data binary, ids array<long>, cluster binary, upper binary, lower binary, sums array<long>, distances array<long>, spent long"
ARROW = pa.schema(
    [("n", pa.int32()), ("wide", pa.int32()), ("data", pa.binary()), ("ids", pa.list_(pa.int64()))]
    + [(c, pa.binary()) for c in ("cluster", "upper", "lower")]
    + [("sums", pa.list_(pa.int64())), ("distances", pa.list_(pa.int64())), ("spent", pa.int64())]
)


def above(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats, rounded up by more than any rounding before."""
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the columns of x (dims, n) to one centroid, or to a centroid each (dims, n)."""
    gap = x.astype(np.int64) - (c if c.ndim == 2 else c[:, None])
    return np.einsum("dn,dn->n", gap, gap)


class Elkan:
    """What a round needs of the centroids (k, dims): half their distances to each other, and how far each has moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        gaps = centroids[:, None, :] - centroids[None, :, :]
        self.half = below(np.sqrt((gaps * gaps).sum(axis=2).astype(np.float64)) / 2)
        own = self.half + np.diag(np.full(len(centroids), np.float32(np.inf)))
        self.nearest_half = own.min(axis=1)
        self.moved = None if before is None else above(np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(np.float64)))

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings cluster (n), upper (n) and lower (k, n) up to date in place; returns how many distances it took."""
        if self.moved is not None:
            upper[:] = above(upper.astype(np.float64) + self.moved[cluster])
            lower[:] = below(lower.astype(np.float64) - self.moved[:, None].astype(np.float64))
        rows = np.flatnonzero(~(self.nearest_half[cluster] > upper))
        doubtful = ~(lower[:, rows] > upper[rows]) & ~(self.half[:, cluster[rows]] > upper[rows])
        doubtful[cluster[rows], np.arange(len(rows))] = False
        rows = rows[doubtful.any(axis=0)]
        if not len(rows):
            return 0
        part, best = x[:, rows], cluster[rows]
        least = squared(part, self.centroids.T[:, best])
        spent, far = len(rows), np.sqrt(least.astype(np.float64))
        up, low = above(far), lower[:, rows]
        low[best, np.arange(len(rows))] = below(far)
        for j in range(len(self.centroids)):
            todo = np.flatnonzero((best != j) & ~(low[j] > up) & ~(self.half[best, j] > up))
            if not len(todo):
                continue
            d = squared(part[:, todo], self.centroids[j])
            spent += len(todo)
            far = np.sqrt(d.astype(np.float64))
            low[j, todo] = below(far)
            won = (d < least[todo]) | ((d == least[todo]) & (j < best[todo]))
            gone = todo[won]
            best[gone], least[gone], up[gone] = j, d[won], above(far[won])
        cluster[rows], upper[rows], lower[:, rows] = best, up, low
        return spent


def _round(elkan: Elkan, first: bool, last: bool):
    """A task's part of a round. sums: for each cluster its vectors' components and their number; in the last round instead
    its vectors' distances, as high and low 32 bits."""
    k, dims = elkan.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, wide, data = (batch.column(c)[i].as_py() for c in range(3))
                x = unpack(data, wide, dims, n)
                if first:
                    cluster, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf, np.float32), np.zeros((k, n), np.float32)
                else:
                    held = [batch.column(c)[i].as_py() for c in (4, 5, 6)]
                    cluster, upper, lower = np.frombuffer(held[0], np.int32).copy(), np.frombuffer(held[1], np.float32).copy(), np.frombuffer(held[2], np.float32).reshape(k, n).copy()
                spent = elkan.assign(x, cluster, upper, lower)
                if last:
                    d = squared(x, elkan.centroids.T[:, cluster])
                    sums = [s for j in range(k) for s in (int((d[cluster == j] >> 32).sum()), int((d[cluster == j] & 0xFFFFFFFF).sum()))]
                else:
                    d = None
                    sums = [s for j in range(k) for s in (*x[:, cluster == j].sum(axis=1, dtype=np.int64).tolist(), int((cluster == j).sum()))]
                row = [pa.array([n], pa.int32()), pa.array([wide], pa.int32()), pa.array([None if last else data], pa.binary()), batch.column(3).slice(i, 1)]
                row += [pa.array([a], pa.binary()) for a in (cluster.tobytes(), None if last else upper.tobytes(), None if last else lower.tobytes())]
                row += [pa.array([sums], pa.list_(pa.int64())), pa.array([None if d is None else d], pa.list_(pa.int64())), pa.array([spent], pa.int64())]
                yield pa.RecordBatch.from_arrays(row, schema=ARROW)

    return run


def _sums(state: DataFrame, size: int) -> list[int]:
    """The blocks' sums added up place by place; reads that column only."""
    out = [0] * size
    for pos, s in state.select(F.posexplode("sums").alias("pos", "s")).groupBy("pos").agg(F.sum("s")).collect():
        out[pos] = s
    return out


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            cluster = np.frombuffer(batch.column(1)[i].as_py(), np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), pa.array(cluster), batch.column(2).slice(i, 1).flatten()], ["vec_id", "cluster", "distance"])


def centroid_clusters(
    vectors: DataFrame, scratch: Scratch, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int | None = DIMS, scale: int = SCALE, seed: str = SEED
) -> tuple[DataFrame, dict]:
    """(vec_id, cluster, distance; {"centroids", "inertia" by cluster, "spent" distances of each round, "vectors"}).

    Kept are the vectors with exactly ``dims`` components (None: the number that most have), none null or not finite. Centroids start as the vectors
    with the smallest SHA-256 of ``seed:id``; a null id is never one, equal ids go by their components. Fewer vectors than k give fewer centroids. Repeated rows are
    clustered each. A vector with a component too large for 64-bit distances (``vectors.largest``) takes no part and has cluster and
    distance null. Extra columns don't matter; an empty table gives no rows and no centroids.
    """
    blocks = scratch.save(blocks_of(vectors, scale, id_col=id_col, vector_col=vector_col), "blocks")
    dims = main_length(blocks) if dims is None else dims
    blocks = blocks.where(F.col("dims") == dims) if dims is not None else blocks.limit(0)
    near = blocks.where("data IS NOT NULL")
    beyond = blocks.where("data IS NULL").select(F.explode("ids").alias("vec_id")).selectExpr("vec_id", "CAST(NULL AS INT) AS cluster", "CAST(NULL AS LONG) AS distance")
    centroids = _start(near, k, seed, dims or 0)
    info = {"centroids": centroids, "inertia": [], "spent": [], "vectors": 0}
    if not len(centroids):
        rest = near.select(F.explode("ids").alias("vec_id")).selectExpr("vec_id", "CAST(NULL AS INT) AS cluster", "CAST(NULL AS LONG) AS distance")
        return beyond.unionByName(rest), info
    state, before, k = near.select("n", "wide", "data", "ids"), None, len(centroids)
    for r in range(rounds + 1):
        last = r == rounds
        state = scratch.save(state.mapInArrow(_round(Elkan(centroids, before), r == 0, last), STATE), f"round{r}")
        scratch.drop(f"round{r - 1}" if r else "none")
        n, spent = state.agg(F.sum("n"), F.sum("spent")).first()
        info["spent"].append(spent)
        if last:
            sums = _sums(state, 2 * k)
            info |= {"vectors": n, "centroids": centroids, "inertia": [(h << 32) + low for h, low in zip(sums[::2], sums[1::2], strict=True)]}
        else:
            sums = np.array(_sums(state, k * (dims + 1)), np.int64).reshape(k, dims + 1)
            count = sums[:, dims:]
            before, centroids = centroids, np.where(count > 0, sums[:, :dims] // np.maximum(count, 1), centroids)
    out = state.select("ids", "cluster", "distances").mapInArrow(_clusters, "vec_id long, cluster int, distance long")
    return out.unionByName(beyond), info


def _start(blocks: DataFrame, k: int, seed: str, dims: int) -> np.ndarray:
    """(k, dims): first the ids with the smallest hashes, then these vectors alone are fetched."""
    ids = blocks.select(F.explode("ids").alias("id")).where("id IS NOT NULL")
    hashed = ids.select("id", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256).alias("h"))
    first = list(dict.fromkeys(r["id"] for r in hashed.orderBy("h").limit(k).collect()))
    if not first:
        return np.zeros((0, dims), np.int64)
    place = {i: p for p, i in enumerate(first)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, n, wide, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                x = unpack(data, wide, dims, n).T
                found = sorted({(place[i], tuple(x[at].tolist())) for at, i in enumerate(own) if i in place})
                counts = [sum(1 for at, i in enumerate(own) if i is not None and place.get(i) == p and tuple(x[at].tolist()) == v) for p, v in found]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([list(f[1]) for f in found], pa.list_(pa.int64())), pa.array(counts, pa.int64())], ["p", "x", "n"])

    rows = blocks.where(F.arrays_overlap("ids", F.array(*[F.lit(i).cast("long") for i in first]))).select("ids", "n", "wide", "data")
    found = rows.mapInArrow(run, "p int, x array<long>, n long").groupBy("p", "x").agg(F.sum("n").alias("n")).orderBy("p", "x").limit(k).collect()
    return np.array([r["x"] for r in found for _ in range(r["n"])], np.int64).reshape(-1, dims)[:k]


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, info = centroid_clusters(table(spark, sf_dir, "embeddings"), Scratch(spark, "clusters"))
    as_long = [i if i < 1 << 63 else None for i in [*info["inertia"], sum(info["inertia"])]]
    rows = [(j, as_long[j], as_long[-1], digest(c)) for j, c in enumerate(info["centroids"])]
    per_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # as many rows as there are centroids
    return out.join(F.broadcast(per_cluster), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {"op13_centroid_clusters": op13_centroid_clusters}


def _sql() -> str:
    near = "SELECT vec_id, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM (SELECT x.vec_id, m.c, sum((x.v - m.v) * (x.v - m.v)) AS d FROM x JOIN {m} m USING (j) GROUP BY ALL) GROUP BY ALL"
    rounds = "".join(
        f""",
n{r} AS MATERIALIZED ({near.format(m=f"m{r}")}),
m{r + 1} AS MATERIALIZED (SELECT m.c, m.j, coalesce(s.v, m.v) AS v FROM m{r} m LEFT JOIN
  (SELECT c, j, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM x JOIN n{r} USING (vec_id) GROUP BY ALL) s USING (c, j))"""
        for r in range(ROUNDS)
    )
    return f"""
WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, j, CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT) AS v FROM (SELECT vec_id, unnest(embedding) AS c, unnest(range({DIMS})) AS j FROM kept)),
m0 AS MATERIALIZED (SELECT CAST(rank - 1 AS INTEGER) AS c, j, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR))) AS rank FROM kept QUALIFY rank <= {K}) USING (vec_id)){rounds},
n AS MATERIALIZED ({near.format(m=f"m{ROUNDS}")}),
h AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM m{ROUNDS} GROUP BY c)
SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM n JOIN h USING (c)
"""


ORACLES = {"op13_centroid_clusters": _sql()}
