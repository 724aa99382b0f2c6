"""Property graphs as two DataFrames, and graph algorithms as DataFrame iterations.

Every loop keeps its state in a DataFrame that is checkpointed as it goes; only single numbers (how
much changed) come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col
from ..plans.events import emit, span
from ..plans.session import cut


FEW_VERTICES = 500_000  # of (id, number) rows: about 16 MB


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    vertex_id: str = "id"
    edge_src: str = "src"
    edge_dst: str = "dst"
    from_edges: bool = False  # the vertices are the ends of the edges

    @classmethod
    def from_edgelist(cls, edges: DataFrame, edge_src: str = "src", edge_dst: str = "dst", vertex_id: str = "id") -> Graph:
        ends = edges.select(col(edge_src).alias(vertex_id)).union(edges.select(col(edge_dst).alias(vertex_id)))
        return cls(ends.where(col(vertex_id).isNotNull()).distinct(), edges, vertex_id, edge_src, edge_dst, True)

    def distribute(self, workers: object = None) -> Graph:
        """Spark distributes as it is; kept so that pipelines read the same."""
        return self

    def _ids(self, pairs: DataFrame | None = None) -> DataFrame:
        """Distinct vertices; ``pairs`` (s, d), all edges at hand, spare another run of the edges' query where they tell."""
        if pairs is not None and self.from_edges:
            return pairs.select(F.explode(F.array("s", "d")).alias("v")).where("v IS NOT NULL").distinct()
        return self.vertices.select(col(self.vertex_id).alias("v")).distinct()

    def _pairs(self) -> DataFrame:
        return self.edges.select(col(self.edge_src).alias("s"), col(self.edge_dst).alias("d")).where("s IS NOT NULL AND d IS NOT NULL")

    def _both(self, distinct: bool = True) -> DataFrame:
        e = self._pairs()
        both = e.union(e.select(F.col("d").alias("s"), F.col("s").alias("d")))
        return both.distinct() if distinct else both

    def vertex_count(self) -> int:
        return self.vertices.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def __repr__(self) -> str:
        v, e = self.vertex_count(), self.edge_count()
        density = e / (v * (v - 1)) if v > 1 else 0.0
        return f"#Graph<{v} vertices, {e} edges, density {density:.4f}, avg_degree {e / v if v else 0:.2f}>"

    def out_degree(self) -> DataFrame:
        return self._pairs().groupBy(F.col("s").alias(self.vertex_id)).agg(F.count("*").alias("out_degree"))

    def in_degree(self) -> DataFrame:
        return self._pairs().groupBy(F.col("d").alias(self.vertex_id)).agg(F.count("*").alias("in_degree"))

    def degree(self) -> DataFrame:
        """In and out together; a loop counts twice, vertices without edges are left out."""
        return self._both(distinct=False).groupBy(F.col("s").alias(self.vertex_id)).agg(F.count("*").alias("degree"))

    def pagerank(self, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
        """(id, rank): (1 - d)/n + d * sum of rank / out-degree; dangling mass is not spread again.

        Stops when the L1 change falls under ``tolerance``, looked at from the second iteration on; 0
        runs all iterations.
        """
        with span(("graph", "algorithm"), algorithm="pagerank"):
            # parallel edges are one row with a share; edges with one end only name a vertex
            counted = cut(self.edges.groupBy(col(self.edge_src).alias("s"), col(self.edge_dst).alias("d")).agg(F.count("*").alias("c")))
            ids = cut(self._ids(counted))
            n = ids.count()
            if not n:
                return self.vertices.select(col(self.vertex_id), F.lit(0.0).alias("rank")).limit(0)
            whole = counted.where("s IS NOT NULL AND d IS NOT NULL")
            out = whole.groupBy("s").agg(F.sum("c").alias("n"))
            shares = cut(whole.join(out, "s").select("s", "d", (F.col("c") / F.col("n")).alias("share")))
            ranks = ids.select("v", F.lit(1.0 / n).alias("rank"))
            sized = F.broadcast if n <= FEW_VERTICES else (lambda df: df)  # then the shares stay where they are
            for i in range(max_iterations):
                sums = shares.join(sized(ranks), shares["s"] == ranks["v"]).groupBy("d").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
                new = ids.join(sums, ids["v"] == sums["d"], "left").select("v", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
                delta = None
                if tolerance and i >= 1:
                    new = cut(new)
                    old = ranks.withColumnRenamed("rank", "old")
                    delta = new.join(old, "v").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
                elif i % 3 == 2:
                    new = cut(new)
                emit(("graph", "iteration", "stop"), {"iteration": i + 1}, {"algorithm": "pagerank", "delta": delta})
                ranks = new
                if delta is not None and delta < tolerance:
                    break
            return ranks.select(F.col("v").alias(self.vertex_id), "rank")

    def shortest_paths(self, source: object, max_depth: float = 1000, weight: str | None = None) -> DataFrame:
        """(node, dist) along directed edges; with ``weight`` the least cost, ``max_depth`` bounds the cost."""
        with span(("graph", "algorithm"), algorithm="shortest_paths"):
            spark = self.edges.sparkSession
            kind = dict(self.edges.dtypes)[self.edge_src]
            start = spark.range(1).select(F.lit(source).cast(kind).alias("node"))
            if weight is None:
                edges = cut(self._pairs().distinct())
                seen = cut(start.select("node", F.lit(0).cast("long").alias("dist")))
                front, depth = seen, 0
                while depth < max_depth:
                    depth += 1
                    reached = edges.join(front, edges["s"] == front["node"]).select(F.col("d").alias("node")).distinct()
                    front = cut(reached.join(seen, "node", "left_anti").select("node", F.lit(depth).cast("long").alias("dist")))
                    if front.isEmpty():
                        break
                    seen = cut(seen.union(front)) if depth % 5 == 0 else seen.union(front)
                return seen
            e = self.edges.select(col(self.edge_src).alias("s"), col(self.edge_dst).alias("d"), col(weight).cast("double").alias("w")).where("s IS NOT NULL AND d IS NOT NULL AND w IS NOT NULL")
            edges = cut(e.groupBy("s", "d").agg(F.min("w").alias("w")))
            best = cut(start.select("node", F.lit(0.0).alias("dist")))
            front = best
            while True:
                reached = edges.join(front, edges["s"] == front["node"]).groupBy(F.col("d").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("new")).where(F.col("new") <= max_depth)
                merged = cut(best.join(reached, "node", "full").select("node", F.col("dist").alias("old"), F.least(F.col("dist"), F.col("new")).alias("dist")))
                front = merged.where("old IS NULL OR dist < old").select("node", "dist")
                best = merged.select("node", "dist")
                if front.isEmpty():
                    return best

    def connected_components(self, max_iterations: int = 100) -> DataFrame:
        """(id, component): the least vertex id that is reachable, edges taken both ways."""
        with span(("graph", "algorithm"), algorithm="connected_components"):
            edges = cut(self._both().where("s <> d"))
            labels = cut(self._ids().select("v", F.col("v").alias("label")))
            for i in range(max_iterations):
                near = edges.join(labels, edges["d"] == labels["v"]).groupBy(F.col("s").alias("v")).agg(F.min("label").alias("near"))
                low = labels.join(near, "v", "left").select("v", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
                jump = labels.select(F.col("v").alias("label"), F.col("label").alias("next"))
                new = cut(low.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
                changed = not new.where("old <> label").isEmpty()
                emit(("graph", "iteration", "stop"), {"iteration": i + 1}, {"algorithm": "connected_components"})
                labels = new.select("v", "label")
                if not changed:
                    break
            return labels.select(F.col("v").alias(self.vertex_id), F.col("label").alias("component"))

    def communities(self, max_iterations: int = 20) -> DataFrame:
        """(id, community) by synchronous label propagation; own label votes too, ties go to the least."""
        with span(("graph", "algorithm"), algorithm="communities"):
            edges = cut(self._both())
            labels = cut(self._ids().select("v", F.col("v").alias("label")))
            for i in range(max_iterations):
                votes = edges.join(labels, edges["d"] == labels["v"]).select(F.col("s").alias("v"), "label").unionByName(labels)
                counted = votes.groupBy("v", "label").agg(F.count("*").alias("n"))
                won = counted.groupBy("v").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("label"))).alias("w")).select("v", F.col("w.label").alias("label"))
                new = cut(labels.withColumnRenamed("label", "old").join(won, "v"))
                changed = not new.where("old <> label").isEmpty()
                emit(("graph", "iteration", "stop"), {"iteration": i + 1}, {"algorithm": "communities"})
                labels = new.select("v", "label")
                if not changed:
                    break
            return labels.select(F.col("v").alias(self.vertex_id), F.col("label").alias("community"))

    def triangles(self) -> DataFrame:
        """Distinct (a, b, c), a < b < c, with edges a to b, b to c and c to a.

        Linked vertices are pairs that go from the end of less degree to the other (ties by id). The two
        pairs that leave a triangle's first corner make a wedge there, and a third pair closes it: each
        triangle comes once, and no vertex has more than the root of twice the pairs going out, so hubs
        make no large products.
        """
        e = self._pairs().where("s <> d")
        up = F.col("s") < F.col("d")
        pairs = cut(e.groupBy(F.least("s", "d").alias("lo"), F.greatest("s", "d").alias("hi")).agg(F.max(up).alias("up"), F.max(~up).alias("down")))
        degree = cut(pairs.select(F.explode(F.array("lo", "hi")).alias("v")).groupBy("v").agg(F.count("*").alias("n")))
        ends = pairs.join(degree.toDF("lo", "nl"), "lo").join(degree.toDF("hi", "nh"), "hi")
        low, high = F.struct(F.col("nl").alias("n"), F.col("lo").alias("v")), F.struct(F.col("nh").alias("n"), F.col("hi").alias("v"))
        way = cut(ends.select(F.least(low, high).alias("x"), F.greatest(low, high).alias("y"), "up", "down").select(F.col("x.v").alias("x"), "y", "up", "down"))
        one = way.select("x", "y", F.col("up").alias("up1"), F.col("down").alias("down1"))
        two = way.select("x", F.col("y").alias("z"), F.col("up").alias("up2"), F.col("down").alias("down2"))
        x, y, z = F.col("x"), F.col("y.v"), F.col("z.v")

        def fits(a: Column, b: Column, other: Column, up: str, down: str) -> Column:
            """The pair of the least and the greatest corner needs the way down, any other the way up."""
            return F.when((other > F.least(a, b)) & (other < F.greatest(a, b)), F.col(down)).otherwise(F.col(up))

        wedges = one.join(two, "x").where(F.col("y") < F.col("z")).where(fits(x, y, z, "up1", "down1") & fits(x, z, y, "up2", "down2"))
        closing = way.select(F.col("x").alias("p"), F.col("y.v").alias("q"), "up", "down")
        closed = wedges.select(x.alias("x"), y.alias("p"), z.alias("q")).join(closing, ["p", "q"]).where(fits(F.col("p"), F.col("q"), F.col("x"), "up", "down"))
        corners = F.array_sort(F.array("x", "p", "q"))
        return closed.select(corners.alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))

    def triangle_count(self) -> int:
        with span(("graph", "algorithm"), algorithm="triangle_count"):
            return self.triangles().count()

    def betweenness_centrality(self, sample: int | None = None, seed: int = 0, normalize: bool = True) -> DataFrame:
        """(id, bc) by Brandes' algorithm, all sampled sources level by level in one table.

        Edges are taken both ways. State is one row per (source, reached vertex): paths are counted
        forward by level, dependencies summed backward. Sources are sampled in the order of a digest of
        ``seed`` and the id, so a sample is the same everywhere.
        """
        with span(("graph", "algorithm"), algorithm="betweenness_centrality"):
            ids = cut(self._ids())
            n = ids.count()
            size = min(n, 100) if sample is None else min(sample, n)
            edges = cut(self._both().where("s <> d"))
            sources = cut(ids.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("v").cast("string"))), "v").limit(size)) if size < n else ids
            levels = [cut(sources.select(F.col("v").alias("src"), "v", F.lit(1.0).alias("sigma")))]
            seen = levels[0].select("src", "v")
            while True:
                last = levels[-1]
                step = edges.join(last, edges["s"] == last["v"]).select("src", F.col("d").alias("v"), "sigma").groupBy("src", "v").agg(F.sum("sigma").alias("sigma"))
                fresh = cut(step.join(seen, ["src", "v"], "left_anti"))
                if fresh.isEmpty():
                    break
                levels.append(fresh)
                seen = cut(seen.union(fresh.select("src", "v"))) if len(levels) % 5 == 0 else seen.union(fresh.select("src", "v"))
            scale = n / size if size else 1.0
            if normalize and n > 2:
                scale *= 2.0 / ((n - 1) * (n - 2))
            below = None
            parts = []
            for at in range(len(levels) - 1, 0, -1):
                own = levels[at]
                if below is None:
                    delta = own.withColumn("delta", F.lit(0.0))
                else:
                    delta = own.join(below, ["src", "v"], "left").select("src", "v", "sigma", F.coalesce("up", F.lit(0.0)).alias("delta"))
                delta = cut(delta)
                parts.append(delta.select("v", "delta"))
                above = levels[at - 1].select("src", F.col("v").alias("p"), F.col("sigma").alias("ps"))
                flow = delta.join(edges, delta["v"] == edges["d"]).select("src", F.col("s").alias("p"), (F.lit(1.0) + F.col("delta")).alias("x"), "sigma").join(above, ["src", "p"])
                below = flow.groupBy("src", F.col("p").alias("v")).agg(F.sum(F.col("ps") / F.col("sigma") * F.col("x")).alias("up"))
            out = ids.select("v", F.lit(0.0).alias("delta"))
            for p in parts:
                out = out.unionByName(p)
            return out.groupBy(F.col("v").alias(self.vertex_id)).agg((F.sum("delta") * scale).alias("bc"))
