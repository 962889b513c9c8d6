"""Inverted indexes: from an edge or a vertex to the trips that use it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lists import BLOCK_BITS, id_blocks, repeated_id_blocks


def _first_sites(seq: DataFrame, id_col: str) -> DataFrame:
    return seq.groupBy(F.col(id_col).alias("key_id"), "traj_id").agg(F.min("site").alias("site"))


def edge_index(traj_edges: DataFrame) -> DataFrame:
    """Postings (key_id, traj_id, site): first site of every edge within every trip (A3)."""
    return _first_sites(traj_edges, "edge_id")


def vertex_index(traj_vertices: DataFrame) -> DataFrame:
    """Postings (key_id, traj_id, site): first site of every vertex within every trip (A4)."""
    return _first_sites(traj_vertices, "vertex_id")


def edge_postings(traj_edges: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Trip ids per edge, a repeat for each use, in bounded blocks (A5)."""
    return repeated_id_blocks(traj_edges, ["edge_id"], "traj_id", "trajs", block_bits)


def vertex_postings(traj_vertices: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Trip ids per vertex, a repeat for each visit, in bounded blocks (A6, list form)."""
    return repeated_id_blocks(traj_vertices, ["vertex_id"], "traj_id", "trajs", block_bits)


def vertex_bitmap(traj_vertices: DataFrame) -> DataFrame:
    """Trip ids per vertex as bit sets, one row per (vertex, bucket of ids) (A6, set form)."""
    return traj_vertices.groupBy("vertex_id", F.bitmap_bucket_number("traj_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("traj_id")).alias("bits")
    )


def edge_bitmap(traj_edges: DataFrame) -> DataFrame:
    """Trip ids per edge as bit sets, one row per (edge, bucket of ids) (A5, set form)."""
    return traj_edges.groupBy("edge_id", F.bitmap_bucket_number("traj_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("traj_id")).alias("bits")
    )


#: Ids in a bucket of a bit set: a fixed value of the built-in functions.
BUCKET_IDS = 32768


def bitmap_ids(bitmap: DataFrame, *keys: str) -> DataFrame:
    """(keys, id): the ids in the bit sets (keys, bucket, bits), one row each."""
    byte = F.transform(
        F.sequence(F.lit(0), F.length("bits") - 1),
        lambda i: F.struct(i.alias("i"), F.conv(F.hex(F.substring("bits", i + 1, F.lit(1))), 16, 10).cast("int").alias("b")),
    )
    places = F.flatten(
        F.transform(
            F.filter(byte, lambda x: x["b"] > 0),
            lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(x["b"].cast("bigint"), k) == 1), lambda k: x["i"] * 8 + k),
        )
    )
    bucket, at = F.col("bucket"), F.col("_at")
    # positive ids count up from bucket 1, the others down from bucket 0
    ids = F.when(bucket > 0, (bucket - 1) * BUCKET_IDS + at + 1).otherwise(bucket * BUCKET_IDS - at)
    return bitmap.select(*keys, "bucket", F.explode(places).alias("_at")).select(*keys, ids.alias("id"))


def bitmap_sizes(bitmap: DataFrame) -> DataFrame:
    """Number of different trips per vertex, counted from the bit sets."""
    return bitmap.groupBy("vertex_id").agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias("n"))


def lookup_postings(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """Postings of the listed keys."""
    return postings.join(keys.select("key_id"), "key_id", "left_semi")


def postings_of(postings: DataFrame, key_id: int) -> DataFrame:
    """Postings of one key (S9); on a stored table sorted by key the filter prunes row groups."""
    return postings.where(F.col("key_id") == key_id)


def adjacency_out(edges: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Edges leaving each vertex, in bounded blocks."""
    ends = edges.select(F.col("s_id").alias("vertex_id"), "edge_id")
    return id_blocks(ends, ["vertex_id"], "edge_id", "edges", block_bits)


def adjacency_in(edges: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Edges entering each vertex, in bounded blocks."""
    ends = edges.select(F.col("e_id").alias("vertex_id"), "edge_id")
    return id_blocks(ends, ["vertex_id"], "edge_id", "edges", block_bits)


def incident_edges(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vertex_id, edge_id) for edges that start or end at a wanted vertex."""
    wanted = wanted.select("vertex_id").distinct()
    leaving = edges.select(F.col("s_id").alias("vertex_id"), "edge_id")
    entering = edges.where(F.col("e_id") != F.col("s_id")).select(F.col("e_id").alias("vertex_id"), "edge_id")
    return leaving.unionByName(entering).join(wanted, "vertex_id", "left_semi")
