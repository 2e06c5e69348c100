"""Merkle fixity audit of WARC archives kept as replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelattice.llm.records import only
from cuelattice.session import cut_lineage

CRLF = "\r\n"


def warc_records(pages: DataFrame, pages_per_archive: int = 500) -> DataFrame:
    """Pages as response records of WARC archives: ``archive``, ``offset``, ``record_id``, ``record`` (binary).

    Needs ``page_id``, ``url`` and ``html``. An archive takes ``pages_per_archive`` consecutive page numbers, so
    its offsets are sums over a bounded group. Defined cases: null html is an empty body, a null url an empty
    target; a null page_id is page 0; rows that repeat a page_id are records of their own, one after the other.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    page = F.coalesce(F.col("page_id").cast("long"), F.lit(0).cast("long"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:page:"), page.cast("string"), F.lit(f">{CRLF}WARC-Target-URI: "),
        F.coalesce("url", F.lit("")), F.lit(f"{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF))
    record = F.concat(head.cast("binary"), body, F.lit(CRLF + CRLF).cast("binary"))
    rows = only(pages, "page_id", "url", "html").select(
        F.expr(f"coalesce(cast(page_id AS bigint), 0L) div {pages_per_archive}L").alias("archive"), page.alias("record_id"), record.alias("record"))
    size = F.octet_length("record").cast("long")
    before = Window.partitionBy("archive").orderBy("record_id", F.xxhash64("record")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("archive", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("offset"), "record_id", "record")


def _nodes(leaves: DataFrame, range_bytes: int, fanout: int, levels: int) -> DataFrame:
    """All tree nodes: (replica, archive, level, node, digest); level 0 are records, by offset."""
    below = leaves.selectExpr("replica", "archive", "0 AS level", "offset AS node", "digest")
    nodes = below
    for level in range(1, levels + 1):
        parent = F.expr(f"node div {range_bytes if level == 1 else fanout}")
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        text = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"], c["digest"])), ",")
        below = below.withColumn("_parent", parent).groupBy("replica", "archive", "_parent").agg(F.sha2(text, 256).alias("digest")).select(
            "replica", "archive", F.lit(level).alias("level"), F.col("_parent").alias("node"), "digest")
        nodes = nodes.unionByName(below)
    return nodes


def fixity_audit(replica_a: DataFrame, replica_b: DataFrame, range_bytes: int = 65_536, fanout: int = 64) -> DataFrame:
    """Locate the records in which two replicas of WARC archives differ.

    The project keeps no archives, so this operator is general: each replica has ``archive``, ``offset`` and
    ``record`` (binary). Returns one row per record place that differs: ``archive``, ``offset``, ``digest_a`` and
    ``digest_b`` (SHA-256 of the record, null where a replica has none there) and ``finding``: ``changed``,
    ``missing in a`` or ``missing in b``.

    Records are leaves. Nodes above them are offset ranges: the first level covers ``range_bytes``, each further
    one ``fanout`` ranges of the level below, up to one root for the longest archive; a node hashes the digests
    and places of its children in order. Roots are compared first, and from then on only the children of nodes
    that differ are joined, level by level, so what is compared grows with the damage and not with the archives. A
    node has at most ``fanout`` children, or the records that start within ``range_bytes``.

    Defined cases: a null record has the digest of no bytes; rows without archive or offset are ignored; several
    records at one place are one leaf over their digests in order; an archive that one replica lacks is missing
    there record by record; empty replicas give an empty result; other columns are ignored.
    """
    sides = [
        only(df, "archive", "offset", "record").where("archive IS NOT NULL AND offset IS NOT NULL").select(
            F.lit(name).alias("replica"), "archive", F.col("offset").cast("long").alias("offset"), F.sha2(F.coalesce("record", F.lit(b"")), 256).alias("digest"))
        for name, df in (("a", replica_a), ("b", replica_b))
    ]
    several = F.array_sort(F.collect_list("digest"))
    leaves = cut_lineage(sides[0].union(sides[1]).groupBy("replica", "archive", "offset").agg(several.alias("_d")).select(
        "replica", "archive", "offset", F.when(F.size("_d") == 1, F.col("_d")[0]).otherwise(F.sha2(F.array_join("_d", ","), 256)).alias("digest")))
    last = leaves.agg(F.max("offset")).first()[0] or 0
    levels, reach = 1, range_bytes
    while reach <= last:
        levels, reach = levels + 1, reach * fanout
    nodes = cut_lineage(_nodes(leaves, range_bytes, fanout, levels).repartition("archive", "node"))

    def compared(level: int, within: DataFrame | None) -> DataFrame:
        own = nodes.where(F.col("level") == level)
        if within is not None:
            own = own.withColumn("_parent", F.expr(f"node div {range_bytes if level == 0 else fanout}")).join(
                within.select("archive", F.col("node").alias("_parent")), ["archive", "_parent"], "left_semi")
        both = own.groupBy("archive", "node").agg(
            F.max(F.when(F.col("replica") == "a", F.col("digest"))).alias("digest_a"), F.max(F.when(F.col("replica") == "b", F.col("digest"))).alias("digest_b"))
        return both.where("NOT digest_a <=> digest_b")

    wrong = compared(levels, None)
    for level in range(levels - 1, -1, -1):
        wrong = compared(level, wrong)
    finding = F.when(F.col("digest_a").isNull(), "missing in a").when(F.col("digest_b").isNull(), "missing in b").otherwise("changed")
    return wrong.select("archive", F.col("node").alias("offset"), "digest_a", "digest_b", finding.alias("finding"))
