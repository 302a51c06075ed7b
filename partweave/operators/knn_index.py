"""A kept index for exact nearest neighbours, in which only the vectors of a batch are queries.

The index holds every vector with its pivot cell and its list of k nearest neighbours, in one bucket a cell
(``sources.buckets``).  Adding a batch does two things, both by the triangle inequality on unit vectors:

* forward - a new vector visits the cells that can hold one of its k nearest, old or new;
* reverse - it visits the cells with a vector whose list it can enter: those no farther than the cell's widest list.

Cells that no new vector visits are neither read nor written, and the lists equal those of ``knn_join`` over all vectors.
How far lists reach, how many vectors lie how near to the pivot and its extent are kept for each cell in the version file
and recomputed for rewritten cells only.

Pivots are fitted on the first batch (at most ``pivots`` vectors of least hash).  The driver holds pivots and one line of
facts a cell (groups times pivots, MAX_BUCKETS at most).  A vector that is null, zero or without a group has no
neighbours and is left out; a batch that is added twice changes nothing; lists of ties keep the smaller ids."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.buckets import MAX_BUCKETS, BucketedTable
from .knn import DIGITS, _distances, _unit

GRID = [round(0.1 * i, 1) for i in range(1, 21)]
#: Cosines are compared after rounding, so vectors this much farther can still tie.
SLACK = 1e-4
NEAR = "array<struct<cosine:double,neighbor_id:{}>>"


class KnnIndex:
    def __init__(self, spark: SparkSession, path: str, k: int, pivots: int = 32, tile: int = 2000):
        self.spark, self.k, self.pivots, self.tile = spark, k, pivots, tile
        widest = F.when(F.size("near") < k, F.lit(9.0)).otherwise(F.sqrt(F.greatest(
            F.lit(0.0), 2 - 2 * F.element_at("near", -1)["cosine"])))
        self.table = BucketedTable(spark, path, "id", place=F.col("cell"), facts={
            "n": F.count(F.lit(1)), "lo": F.min("d"), "hi": F.max("d"), "reach": F.max(widest),
            "within": F.array(*[F.count_if(F.col("d") <= t) for t in GRID])})
        self.read_rows = 0  # rows of the cells that the last batch read

    def neighbours(self) -> DataFrame:
        """(id, neighbor_id, grp, cosine, rank) of all vectors."""
        return self.table.read().select("id", "grp", F.posexplode("near").alias("at", "n")).select(
            "id", "n.neighbor_id", "grp", "n.cosine", (F.col("at") + 1).alias("rank"))

    def add(self, batch: DataFrame, id_col: str, group_col: str, vec_col: str) -> DataFrame | None:
        """Add a batch and return (id, neighbor_id, grp, cosine, rank) of its vectors; None if it holds nothing new."""
        k, id_type = self.k, batch.schema[id_col].dataType.simpleString()
        norm2 = F.aggregate(F.col(vec_col), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        rows = batch.filter(F.col(vec_col).isNotNull() & F.col(group_col).isNotNull() & (norm2 > 0)).select(
            F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("grp"),
            F.col(vec_col).cast("array<double>").alias("vec")).dropDuplicates(["id"])
        rows = cut_lineage(rows)
        state = self.table.state()
        meta = self._meta(state["meta"], rows)
        if not meta["pivots"]:
            return None
        pivot, n_pivots = np.array(meta["pivots"]), len(meta["pivots"])
        group_at = {g: i for i, g in enumerate(meta["groups"])}

        def assign(batches):
            for b in batches:
                d = _distances(_unit(b["vec"]), pivot)
                near = d.argmin(axis=1)
                cell = b["grp"].map(group_at).to_numpy() * n_pivots + near
                yield b.assign(cell=cell.astype("int32"), d=d[np.arange(len(b)), near])

        placed = cut_lineage(rows.mapInPandas(assign, f"id {id_type}, grp string, vec array<double>, cell int, d double"))
        own = {r[0] for r in placed.select("cell").distinct().collect()}  # at most MAX_BUCKETS
        held = self.table.read(state["version"], own)
        if held is not None:
            placed = cut_lineage(placed.join(held.select("id"), "id", "left_anti"))
        fresh = {r["cell"]: r.asDict() for r in placed.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"),
            F.array(*[F.count_if(F.col("d") <= t) for t in GRID]).alias("within")).collect()}
        if not fresh:
            return None
        cells = self._cells({int(c): b["facts"] for c, b in state["buckets"].items()}, fresh, n_pivots)
        gap = _distances(pivot, pivot)

        def visits(b: pd.DataFrame) -> pd.DataFrame:
            out = []
            for g, part in b.groupby("grp", sort=False):
                ids, lo, hi, counts, reach = cells[group_at[g]]
                p = ids % n_pivots
                d = _distances(_unit(part["vec"]), pivot)
                dc = d[:, p]
                # The distance within which k + 1 vectors are certain, the vector itself among them.
                ring = (dc[:, :, None] + np.array(GRID)[None, None, :]).reshape(len(part), -1)
                many = np.broadcast_to(counts.ravel(), ring.shape)
                order = np.argsort(ring, axis=1, kind="stable")
                enough = np.cumsum(np.take_along_axis(many, order, 1), axis=1) >= k + 1
                first = enough.argmax(axis=1)
                bound = np.where(enough.any(axis=1), np.take_along_axis(ring, order, 1)[np.arange(len(part)), first], np.inf)
                mine = part["cell"].to_numpy() % n_pivots
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (dc ** 2 - (part["d"].to_numpy() ** 2)[:, None]) / (2 * gap[mine][:, p])
                plane = np.where(p[None, :] == mine[:, None], 0.0, np.nan_to_num(plane, nan=0.0, posinf=0.0, neginf=0.0))
                lower = np.maximum(np.maximum(dc - hi[None, :], lo[None, :] - dc), plane)
                row, col = np.nonzero(lower <= np.maximum(bound[:, None], reach[None, :]) + SLACK)
                out.append(pd.DataFrame({"id": part["id"].to_numpy()[row], "cell": ids[col].astype("int32"),
                                         "vec": part["vec"].to_numpy()[row]}))
            return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"id": [], "cell": [], "vec": []})

        queries = cut_lineage(placed.mapInPandas(lambda bs: (visits(b) for b in bs), f"id {id_type}, cell int, vec array<double>"))
        load = {r["cell"]: r["n"] for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        old = self.table.read(state["version"], set(load))
        known = {int(c): b["facts"]["n"] for c, b in state["buckets"].items() if int(c) in load}
        self.read_rows = sum(known.values())
        size = {c: known.get(c, 0) + fresh.get(c, {"n": 0})["n"] for c in load}
        found = cut_lineage(self._compare(queries, placed, old, load, size, id_type))

        # Lists: what was found, and for old vectors what they had.
        lists = found
        if old is not None:
            moved = found.select("id").distinct().join(placed.select("id"), "id", "left_anti")
            before = old.join(moved, "id", "left_semi").select("id", F.explode("near").alias("n")).select("id", "n.neighbor_id", "n.cosine")
            lists = found.unionByName(before)
        w = Window.partitionBy("id").orderBy(F.desc("cosine"), F.asc("neighbor_id"))
        best = lists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        near = cut_lineage(best.groupBy("id").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "cosine", "neighbor_id"))),
            lambda r: F.struct(r["cosine"].alias("cosine"), r["neighbor_id"].alias("neighbor_id"))).alias("near")))
        nothing = F.array().cast(NEAR.format(id_type))
        changed = placed.join(near, "id", "left").withColumn("near", F.coalesce("near", nothing))
        if old is not None:
            changed = changed.unionByName(old.drop("near").join(near, "id"))
        changed = cut_lineage(changed)
        self.table.upsert(changed, meta=meta)
        return changed.join(placed.select("id"), "id", "left_semi").select(
            "id", "grp", F.posexplode("near").alias("at", "n")).select(
            "id", "n.neighbor_id", "grp", "n.cosine", (F.col("at") + 1).alias("rank"))

    # ---------------------------------------------------------------------------------------------------------- parts
    def _meta(self, meta: dict, rows: DataFrame) -> dict:
        if not meta:
            sample = rows.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(self.pivots).collect()
            vectors = [np.array(r["vec"]) for r in sample]
            meta = {"pivots": [(v / np.sqrt((v * v).sum())).tolist() for v in vectors], "groups": []}
        most = MAX_BUCKETS // max(1, len(meta["pivots"]))
        found = [r[0] for r in rows.select("grp").distinct().limit(most + 1).collect()]
        groups = meta["groups"] + sorted(set(found) - set(meta["groups"]))
        if len(groups) > most:
            raise ValueError(f"more than {most} groups; use fewer pivots")
        return {"pivots": meta["pivots"], "groups": groups}

    def _cells(self, old: dict[int, dict], fresh: dict[int, dict], n_pivots: int) -> dict[int, tuple]:
        """By group: cells, least and largest pivot distance, vectors in each ring of GRID, and the reach of old lists."""
        out: dict[int, list] = {}
        nothing = {"n": 0, "lo": np.inf, "hi": -np.inf, "within": [0] * len(GRID), "reach": -np.inf}
        for c in sorted({*old, *fresh}):
            a, b = old.get(c, nothing), {**nothing, **fresh.get(c, {})}
            within = np.array(a["within"]) + np.array(b["within"])
            out.setdefault(c // n_pivots, []).append(
                (c, min(a["lo"], b["lo"]), max(a["hi"], b["hi"]), np.diff(within, prepend=0), a["reach"]))
        return {g: tuple(np.array(x) for x in zip(*rows)) for g, rows in out.items()}

    def _compare(self, queries: DataFrame, placed: DataFrame, old: DataFrame | None, load: dict, size: dict, id_type: str) -> DataFrame:
        """(id, neighbor_id, cosine): for new vectors the k nearest of every cell slice, for old ones the new vectors
        that enter their lists.  A large cell is cut into slices of ``tile`` vectors on both sides."""
        k, tile = self.k, self.tile
        grid = [(c, max(1, -(-load[c] // tile)), max(1, -(-size[c] // tile))) for c in sorted(load)]
        slices = lambda mine, other: F.broadcast(self.spark.createDataFrame(grid, f"cell int, {mine} int, {other} int"))  # a row a cell
        targets = placed.select("id", "cell", "vec", F.lit(True).alias("fresh"), F.lit(None).cast("double").alias("least"),
                                F.col("id").alias("least_id"))
        if old is not None:
            last = F.when(F.size("near") >= k, F.element_at("near", -1))
            targets = targets.unionByName(old.select("id", "cell", "vec", F.lit(False).alias("fresh"), last["cosine"].alias("least"),
                                                     F.coalesce(last["neighbor_id"], "id").alias("least_id")))
        slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        q = queries.join(slices("q_own", "q_other"), "cell").withColumn("i", slot("q_own")).withColumn("j", every("q_other")).drop("q_own", "q_other")
        t = targets.join(slices("t_other", "t_own"), "cell").withColumn("j", slot("t_own")).withColumn("i", every("t_other")).drop("t_own", "t_other")

        def nearest(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
            if q.empty or t.empty:
                return pd.DataFrame({"id": [], "neighbor_id": [], "cosine": []})
            q, t = q.sort_values("id", ignore_index=True), t.sort_values("id", ignore_index=True)
            qid, tid = q["id"].to_numpy(), t["id"].to_numpy()
            sim = np.round(_unit(q["vec"]) @ _unit(t["vec"]).T, DIGITS)
            sim[qid[:, None] == tid[None, :]] = -np.inf

            def top(s: np.ndarray):  # stable on sorted ids: the smallest ids of equal similarities
                at = np.argsort(-s, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(s)), at.shape[1])
                ok = np.isfinite(s[rows, at.ravel()])
                return rows[ok], at.ravel()[ok]

            i, j = top(sim)
            out = [pd.DataFrame({"id": qid[i], "neighbor_id": tid[j], "cosine": sim[i, j]})]
            aged = np.flatnonzero(~t["fresh"].to_numpy(bool))
            if len(aged):
                least = t["least"].to_numpy(float)[aged]
                full = ~np.isnan(least)
                ends = t["least_id"].to_numpy()[aged]
                enters = sim[:, aged].T
                before = (qid[None, :] < ends[:, None]).astype(bool)
                fits = ~full[:, None] | (enters > least[:, None]) | ((enters == least[:, None]) & before)
                j, i = top(np.where(fits, enters, -np.inf))
                out.append(pd.DataFrame({"id": tid[aged][j], "neighbor_id": qid[i], "cosine": enters[j, i]}))
            return pd.concat(out, ignore_index=True)

        key = ["cell", "i", "j"]
        return q.groupBy(*key).cogroup(t.groupBy(*key)).applyInPandas(
            nearest, f"id {id_type}, neighbor_id {id_type}, cosine double")
