"""Connected components that follow changes: labels kept in a log, and only what a change touches computed anew.

The log has two append-only tables, edges and labels, each change a version of its own that
is published last. New edges join labels to labels: components are computed over the few
labels they touch, never over their members. Removed nodes bring back the edges of the
components they lay in, and of no others. Both read the log by a small set of nodes, so its
rows are scanned in place and not dealt anew; what is shuffled and written grows with the change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lettermill.operators.components import connected_components, join_hot
from lettermill.session import materialize

_EDGES, _LABELS = "u string, v string, live boolean", "node string, component string"


class ComponentLog:
    """Components of a growing and shrinking graph of string nodes, below one folder of shared storage.

    ``labels`` gives ``(node, component)`` of every node that has an edge; ``component`` is the smallest
    node reachable. An end that is null, or an edge from a node to itself, links nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        """The newest published version; 0 for an empty log."""
        files, path = self._files()
        place = path(f"{self.folder}/published")
        return max([int(f.getPath().getName()) for f in files.listStatus(place)], default=0) if files.exists(place) else 0

    def _log(self, name: str, schema: str) -> DataFrame:
        """All rows of published versions; what a failed change has left is not among them."""
        newest, files_path = self.version(), self._files()
        files, path = files_path
        full = f"{schema}, version int"
        if not newest or not files.exists(path(f"{self.folder}/{name}")):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(f"{self.folder}/{name}").where(F.col("version") <= newest)

    def _publish(self, version: int, edges: DataFrame, labels: DataFrame) -> int:
        for name, df in (("edges", edges), ("labels", labels)):
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/version={version}")
        files, path = self._files()
        # creating fails where another change has published this version in the meantime
        if not files.createNewFile(path(f"{self.folder}/published/{version}")):
            raise RuntimeError(f"version {version} was published by another change; apply the change again")
        return version

    def labels(self) -> DataFrame:
        """``(node, component)`` as of the newest version."""
        newest = self._log("labels", _LABELS).groupBy("node").agg(F.max_by("component", "version").alias("component"))
        return newest.where("component is not null")

    def _labels_of(self, nodes: DataFrame) -> DataFrame:
        rows = self._log("labels", _LABELS).join(nodes.select("node").distinct(), "node", "left_semi")
        return rows.groupBy("node").agg(F.max_by("component", "version").alias("component")).where("component is not null")

    def _members_of(self, components: DataFrame) -> DataFrame:
        """``(node, component)`` of the nodes whose label is one of ``components (component)`` now."""
        once = self._log("labels", _LABELS).join(components.select("component").distinct(), "component", "left_semi")
        return self._labels_of(once).join(components.select("component").distinct(), "component", "left_semi").select("node", "component")

    def _edges_of(self, nodes: DataFrame) -> DataFrame:
        """Live edges with ``u`` among the nodes; ends of an edge always lie in one component."""
        rows = self._log("edges", _EDGES).join(nodes.select(F.col("node").alias("u")).distinct(), "u", "left_semi")
        return rows.groupBy("u", "v").agg(F.max_by("live", "version").alias("live")).where("live").select("u", "v")

    def add(self, edges: DataFrame) -> int:
        """A version with ``edges (u, v)`` added; edges that are there already change nothing."""
        version = self.version() + 1
        new = materialize(edges.select(F.col("u").cast("string"), F.col("v").cast("string")).where("u <> v").distinct(), "log-edge")
        ends = new.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        known = materialize(self._labels_of(ends), "log-label")
        at = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"at_{c}"))
        lifted = join_hot(join_hot(new, at("u"), "u", "left"), at("v"), "v", "left")
        lifted = lifted.select(F.coalesce("at_u", "u").alias("u"), F.coalesce("at_v", "v").alias("v"))
        merged = materialize(connected_components(lifted).select(F.col("node").alias("old"), "component"), "log-merged")
        gone = merged.where("old <> component")
        moved = join_hot(self._members_of(gone.select(F.col("old").alias("component"))).withColumnRenamed("component", "old"), gone, "old").select("node", "component")
        # an end without a label is a node of its own until now
        fresh = ends.join(known, "node", "left_anti").join(merged.withColumnRenamed("old", "node"), "node")
        # a new node may carry the name of a component of which it is no member yet only if it is one of the ends
        changes = moved.unionByName(fresh.select("node", "component")).distinct()
        return self._publish(version, new.withColumn("live", F.lit(True)), changes)

    def remove(self, nodes: DataFrame) -> int:
        """A version without the ``nodes (node)`` and their edges; others of their components are parted where nothing else links them."""
        version = self.version() + 1
        gone = materialize(nodes.select(F.col("node").cast("string")).dropna().distinct(), "log-gone")
        members = materialize(self._members_of(self._labels_of(gone)), "log-member")
        edges = materialize(self._edges_of(members), "log-touched")
        ended = lambda df, how: df.join(gone.withColumnRenamed("node", "u"), "u", how)
        left = ended(edges, "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v")
        dead = edges.join(left, ["u", "v"], "left_anti")
        now = connected_components(left).withColumnRenamed("component", "now")
        labels = members.join(now, "node", "left").where(~F.col("now").eqNullSafe(F.col("component"))).select("node", F.col("now").alias("component"))
        return self._publish(version, dead.withColumn("live", F.lit(False)), labels)


#: a key's node sorts behind every email, so that the smallest node of a component is an email
_KEY = "\U0010ffff"


def exact_key_edges(signals: DataFrame) -> DataFrame:
    """``(u, v)`` from every email to the keys by which exact duplicates agree: no row depends on another email.

    Components are those of ``exact_edges``, whose stars change when an email of less id arrives.
    """
    from lettermill.operators.duplicates import SEMANTIC

    stored = F.when(F.col("storage_hash") != "", F.concat(F.lit(f"{_KEY}s"), "storage_hash"))
    meaning = F.to_json(F.struct(*SEMANTIC, F.lower("message_id").alias("mid"), "metadata_fp"), {"ignoreNullFields": "false"})
    same = F.when(F.col("message_id").isNotNull(), F.concat(F.lit(f"{_KEY}m"), F.sha2(meaning, 256)))
    return signals.select(F.col("id").alias("u"), F.explode(F.array_compact(F.array(stored, same))).alias("v"))


def exact_roots(log: ComponentLog, signals: DataFrame) -> DataFrame:
    """``signals`` with ``root`` from a log that holds their ``exact_key_edges``."""
    emails = log.labels().where(~F.col("node").startswith(_KEY)).withColumnsRenamed({"node": "id", "component": "root"})
    return signals.join(emails, "id", "left").withColumn("root", F.coalesce("root", "id"))
