"""Exact k-nearest-neighbour join by cosine within a group (J2), partitioned by pivots.

Cosine order on unit vectors is Euclidean order, so the triangle inequality can prune: vectors are assigned to the
nearest of P pivots, every query gets an upper bound on its k-th neighbour distance from the cells' smallest pivot
distances, and is sent only to the cells that can hold something closer.  A cell that is too large for one task is cut
into slices of ``tile`` vectors on both sides, so a group that holds most of the data is spread over many tasks.
Nothing is approximated and no candidate is dropped.

Driver-side state is bounded: P pivots and (groups x P) cell statistics, checked before they are collected."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CELLS = 200_000
DIGITS = 9
SLACK = 1e-6


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=np.float64)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * unit @ pivots.T))


def knn_join(df: DataFrame, id_col: str, group_col: str, vec_col: str, k: int, pivots: int = 32,
             tile: int = 2000, per_pivot: int = 2048) -> DataFrame:
    """(id, neighbor_id, group, cosine, rank <= k); ties by neighbour id.  Zero vectors have no direction and are left
    out; give distinct vectors (see ``candidates.variants``) when many copies exist."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    grp_type = df.schema[group_col].dataType.simpleString()
    norm2 = F.aggregate(F.col(vec_col), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    base = df.filter(F.col(vec_col).isNotNull() & F.col(group_col).isNotNull() & (norm2 > 0)).select(
        F.col(id_col).alias("id"), F.col(group_col).alias("grp"),
        F.col(vec_col).cast("array<double>").alias("vec"))

    sizes_df = base.groupBy("grp").count()
    groups, total = sizes_df.agg(F.count("*"), F.sum("count")).first()
    if not groups:
        return spark.createDataFrame(
            [], f"id {id_type}, neighbor_id {id_type}, grp {grp_type}, cosine double, rank int")
    wanted = max(1, min(pivots, total // max(1, groups) // per_pivot, MAX_CELLS // groups))
    sample = base.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(wanted).collect()
    pivot = np.array([r["vec"] for r in sample])
    pivot = pivot / np.sqrt((pivot * pivot).sum(axis=1))[:, None]
    pivot_gap = _distances(pivot, pivot)

    if groups * len(pivot) > MAX_CELLS:
        # more groups than the driver may hold: every group is its own (sliced) cell and no statistics are needed
        return _rank(_tile_join(_single_cell(base), id_type, grp_type, k, tile, None), k)

    def assign(batches):
        for b in batches:
            d = _distances(_unit(b["vec"]), pivot)
            cell = d.argmin(axis=1)
            yield b.assign(cell=cell.astype("int32"), d=d[np.arange(len(b)), cell])

    placed = base.mapInPandas(assign, f"id {id_type}, grp {grp_type}, vec array<double>, cell int, d double")

    def nearest_to_pivot(batches):
        for b in batches:
            yield b.sort_values("d").groupby(["grp", "cell"]).head(k + 1)[["grp", "cell", "d"]]

    slim = placed.select("grp", "cell", "d")
    w = Window.partitionBy("grp", "cell").orderBy("d")
    closest = (slim.mapInPandas(nearest_to_pivot, f"grp {grp_type}, cell int, d double")
               .withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
               .groupBy("grp", "cell").agg(F.sort_array(F.collect_list("d")).alias("closest")))
    stats = slim.groupBy("grp", "cell").agg(
        F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).join(closest, ["grp", "cell"])
    cells: dict = {}
    for r in stats.collect():
        cells.setdefault(r["grp"], []).append((r["cell"], r["n"], r["lo"], r["hi"], list(r["closest"])))
    table = {
        g: (np.array([c[0] for c in rows]), np.array([c[2] for c in rows]), np.array([c[3] for c in rows]),
            np.array([(c[0], x) for c in rows for x in c[4]]))
        for g, rows in cells.items()
    }

    def visits(b: pd.DataFrame, with_vec: bool) -> pd.DataFrame:
        out = []
        for g, part in b.groupby("grp", sort=False):
            ids, lo, hi, near = table[g]
            d = _distances(_unit(part["vec"]), pivot)
            reach = d[:, near[:, 0].astype(int)] + near[:, 1][None, :]
            bound = (np.partition(reach, k, axis=1)[:, k] if reach.shape[1] > k
                     else np.full(len(part), np.inf)) + SLACK
            dc = d[:, ids]
            own = part["cell"].to_numpy()
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (dc ** 2 - (part["d"].to_numpy() ** 2)[:, None]) / (2 * pivot_gap[own][:, ids])
            plane = np.where(ids[None, :] == own[:, None], 0.0, np.nan_to_num(plane, nan=0.0, posinf=0.0, neginf=0.0))
            lower = np.maximum(np.maximum(dc - hi[None, :], lo[None, :] - dc), plane)
            row, col = np.nonzero(lower <= bound[:, None])
            cols = {"id": part["id"].to_numpy()[row], "grp": g, "cell": ids[col].astype("int32")}
            if with_vec:
                cols["vec"] = part["vec"].to_numpy()[row]
            out.append(pd.DataFrame(cols))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(
            {c: [] for c in (["id", "grp", "cell"] + (["vec"] if with_vec else []))})

    def send(batches):
        for b in batches:
            yield visits(b, True)

    def count_visits(batches):
        for b in batches:
            v = visits(b, False).groupby(["grp", "cell"]).size().reset_index(name="n")
            yield v

    load = placed.mapInPandas(count_visits, f"grp {grp_type}, cell int, n bigint").groupBy("grp", "cell").agg(
        F.sum("n").alias("n"))
    q_rows = {(r["grp"], r["cell"]): r["n"] for r in load.collect()}
    grid = {key: (max(1, -(-q_rows.get(key, 1) // tile)), max(1, -(-n // tile)))
            for g, rows in cells.items() for c, n, *_ in rows for key in [(g, c)]}
    queries = placed.mapInPandas(send, f"id {id_type}, grp {grp_type}, cell int, vec array<double>")
    return _rank(_tile_join((queries, placed.select("id", "grp", "cell", "vec")), id_type, grp_type, k, tile, grid), k)


def _single_cell(base: DataFrame):
    one = base.withColumn("cell", F.lit(0))
    return one, one


def _tile_join(sides, id_type: str, grp_type: str, k: int, tile: int, grid: dict | None) -> DataFrame:
    queries, targets = sides
    if grid is None:
        sizes = targets.groupBy("grp", "cell").agg(F.ceil(F.count("*") / F.lit(float(tile))).cast("int").alias("_s"))
        spread = lambda df: df.join(sizes, ["grp", "cell"]).withColumns({"_q": F.col("_s"), "_t": F.col("_s")})
        queries, targets = spread(queries), spread(targets)
    else:
        # every (group, cell) has its slice counts in a table of bounded size
        spark = queries.sparkSession
        rows = [(g, int(c), int(q), int(t)) for (g, c), (q, t) in grid.items()]
        sizes = F.broadcast(spark.createDataFrame(rows, f"grp {grp_type}, cell int, _q int, _t int"))
        queries, targets = queries.join(sizes, ["grp", "cell"]), targets.join(sizes, ["grp", "cell"])
    slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.withColumns({"qi": slot("_q")}).withColumn("ti", every("_t")).select(
        "id", "grp", "cell", "vec", "qi", "ti")
    right = targets.withColumns({"ti": slot("_t")}).withColumn("qi", every("_q")).select(
        "id", "grp", "cell", "vec", "qi", "ti")

    def nearest(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"id": [], "neighbor_id": [], "grp": [], "cosine": []})
        if q.empty or t.empty:
            return empty
        t = t.sort_values("id", ignore_index=True)
        sim = np.round(_unit(q["vec"]) @ _unit(t["vec"]).T, DIGITS)
        tid, qid = t["id"].to_numpy(), q["id"].to_numpy()
        sim[qid[:, None] == tid[None, :]] = -np.inf
        take = min(k, len(t))
        # stable sort on the id-ordered tile keeps the smallest ids among equal similarities
        order = np.argsort(-sim, axis=1, kind="stable")[:, :take]
        rows = np.repeat(np.arange(len(q)), take)
        value = sim[rows, order.ravel()]
        keep = np.isfinite(value)
        return pd.DataFrame({"id": qid[rows][keep], "neighbor_id": tid[order.ravel()][keep],
                             "grp": q["grp"].iloc[0], "cosine": value[keep]})

    key = ["grp", "cell", "qi", "ti"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        nearest, f"id {id_type}, neighbor_id {id_type}, grp {grp_type}, cosine double")


def _rank(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), F.asc("neighbor_id"))
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
