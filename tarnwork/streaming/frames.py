"""Frames as a stream: sites arrive as Parquet files, each batch's whole frames are measured and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph, network
from ..operators.spatial import KEYS


def read_sites(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def frame_metrics(stream: DataFrame, out: str, checkpoint: str, cutoff: float = 3.3, max_neighbors: int = 10) -> StreamingQuery:
    """Density and interaction counts of every frame; a frame must lie in one file.  Batches replace their own output, so
    one that is run again leaves nothing twice."""

    def measure(batch: DataFrame, number: int) -> None:
        edges = network.edges(network.undirected(batch, cutoff, max_neighbors))
        nodes = network.nodes(batch).withColumn("id", F.col("atom_index"))
        found = graph.density(nodes, edges).join(graph.interaction_counts(edges), list(KEYS), "left")
        found.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(measure).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def residue_totals(stream: DataFrame) -> DataFrame:
    """Running interactions and frames of each residue, from a stream of (frame_idx, residue, n)."""
    return stream.groupBy("residue").agg(F.sum("n").alias("n"), F.approx_count_distinct("frame_idx").alias("frames"))
