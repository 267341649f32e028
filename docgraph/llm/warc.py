"""WARC fixity audit with Merkle trees.

A page is written as one WARC response record. The records of FILE consecutive page ids make a file, in the order of
their ids; a record's offsets are its place there. The hash tree has a leaf for every id: the hash of the id's records
and of their bytes. A node of the next level hashes the ids, hashes and byte ranges of up to FANOUT children, up to one
root. Two replicas with equal roots are equal. Otherwise only children of differing nodes are compared, level by level,
down to the leaves that differ; equal branches are never opened. Trees hold digests only, and each level is one
groupBy of the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from docgraph.llm.common import cut

FANOUT, FILE = 16, 1024


def record(page_id: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """The WARC record of a page as text; nulls are empty."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.format_string("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Target-URI: %s\r\nContent-Length: %d\r\n\r\n", F.col(page_id).cast("long"), F.coalesce(F.col(url), F.lit("")), F.octet_length(body))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """(id, digest, bytes, records): a leaf of the tree for every page id."""
    hashed = pages.where("page_id IS NOT NULL").select(F.col("page_id").cast("long").alias("id"), record().alias("r"))
    hashed = hashed.select("id", F.sha2("r", 256).alias("d"), F.octet_length("r").cast("long").alias("n"))
    grouped = hashed.groupBy("id").agg(F.array_sort(F.collect_list("d")).alias("ds"), F.sum("n").alias("bytes"), F.count("*").alias("records"))
    return grouped.select("id", F.sha2(F.concat_ws("", "ds"), 256).alias("digest"), "bytes", "records")


def parents(level: DataFrame) -> DataFrame:
    """The next level of a tree: nodes of FANOUT children, hashed in order with their byte ranges."""
    child = F.struct("id", "digest", "bytes")
    node = F.floor(F.col("id") / FANOUT).cast("long")
    grouped = level.groupBy(node.alias("node")).agg(F.array_sort(F.collect_list(child)).alias("c"), F.sum("bytes").alias("total"))
    sealed = F.concat_ws(",", F.transform("c", lambda x: F.concat_ws(":", x["id"], x["digest"], x["bytes"])))
    return grouped.select(F.col("node").alias("id"), F.sha2(sealed, 256).alias("digest"), F.col("total").alias("bytes"))


def tree(bottom: DataFrame, height: int) -> list[DataFrame]:
    """The levels of a tree, leaves first; each is kept in the shared folder, as each is read twice."""
    levels = [bottom]
    for _ in range(height):
        levels.append(cut(parents(levels[-1])))
    return levels


def _differing(a: DataFrame, b: DataFrame, above: DataFrame | None) -> DataFrame:
    """Ids of the nodes that are not the same in both, among the children of ``above``."""
    if above is not None:
        opened = above.select(F.col("id").alias("up"))
        a, b = (x.join(opened, F.floor(x["id"] / FANOUT) == opened["up"], "left_semi") for x in (a, b))
    a = a.select("id", F.col("digest").alias("da"))
    b = b.select("id", F.col("digest").alias("db"))
    return a.join(b, "id", "full_outer").where("NOT (da <=> db)").select("id")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, kind, file, start_offset, end_offset, replica_bytes): every page on which the replicas differ.

    kind is "missing" or "extra" where only the primary or only the replica has the page, "truncated" where the replica
    has fewer bytes and not more records, "repeated" where it has more records, else "altered". Offsets are those in the
    primary's file, null for extra pages.

    Null ids have no place in an archive and are left out; null urls and texts are written as empty ones; rows that
    repeat an id are one leaf, whatever their order. Other columns are not read. Empty tables differ from others by all
    their pages, and from each other by none.
    """
    a, b = cut(leaves(primary)), cut(leaves(replica))
    top = a.select("id").unionByName(b.select("id")).agg(F.max(F.abs("id"))).first()[0] or 0
    height = 1
    while FANOUT**height <= top:
        height += 1
    levels = list(zip(tree(a, height), tree(b, height), strict=True))
    differ = None
    for x, y in reversed(levels):
        differ = cut(_differing(x, y, differ))
        if differ.isEmpty():
            break
    order = Window.partitionBy("file").orderBy("id")
    held = a.withColumn("file", F.floor(F.col("id") / FILE).cast("long"))
    files = differ.select(F.floor(F.col("id") / FILE).cast("long").alias("file")).distinct()
    placed = held.join(files, "file", "left_semi").withColumn("end_offset", F.sum("bytes").over(order))
    mine = placed.select("id", "file", (F.col("end_offset") - F.col("bytes")).alias("start_offset"), "end_offset", F.col("bytes").alias("na"), F.col("records").alias("ra"))
    other = b.select("id", F.col("bytes").alias("nb"), F.col("records").alias("rb"))
    kind = F.when(F.col("nb").isNull(), "missing").when(F.col("na").isNull(), "extra").when(F.col("rb") > F.col("ra"), "repeated").when(F.col("nb") < F.col("na"), "truncated").otherwise("altered")
    return differ.join(mine, "id", "left").join(other, "id", "left").select(F.col("id").alias("page_id"), kind.alias("kind"), F.floor(F.col("id") / FILE).cast("long").alias("file"), "start_offset", "end_offset", F.coalesce("nb", F.lit(0).cast("long")).alias("replica_bytes"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica for trials: by the first two digits of the md5 of a page's id it is lost, altered, cut or doubled."""
    mark = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    html = F.when(mark == "01", F.concat(F.lit("!"), F.expr("substring(html, 2)"))).when(mark == "02", F.expr("substring(html, 1, length(html) DIV 2)")).otherwise(F.col("html"))
    copies = F.when(mark == "00", 0).when(mark == "03", 2).otherwise(1)
    return pages.select("page_id", "url", html.alias("html"), F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).drop("copy")


def oracle(pages: str = "pages") -> str:
    """The same by a comparison of all leaves."""
    rec = "'WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:' || page_id || '>\r\nWARC-Target-URI: ' || coalesce(url, '') || '\r\nContent-Length: ' || strlen(coalesce(html, '')) || '\r\n\r\n' || coalesce(html, '') || '\r\n\r\n'"
    leaf = "SELECT id, sha256(string_agg(d, '' ORDER BY d)) AS digest, sum(n)::BIGINT AS bytes, count(*) AS records FROM (SELECT page_id AS id, sha256({r}) AS d, strlen({r}) AS n FROM {t} WHERE page_id IS NOT NULL) GROUP BY id"
    return f"""
WITH bad AS (
  SELECT page_id, url, CASE m WHEN '01' THEN '!' || substr(html, 2) WHEN '02' THEN substr(html, 1, length(html) // 2) ELSE html END AS html,
    unnest(range(CASE m WHEN '00' THEN 0 WHEN '03' THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT *, substr(md5(page_id::VARCHAR), 1, 2) AS m FROM {pages})),
a AS ({leaf.format(r=rec, t=pages)}),
b AS ({leaf.format(r=rec, t="bad")}),
o AS (SELECT *, (sum(bytes) OVER (PARTITION BY id // {FILE} ORDER BY id))::BIGINT AS e FROM a)
SELECT coalesce(o.id, b.id) AS page_id,
  CASE WHEN b.id IS NULL THEN 'missing' WHEN o.id IS NULL THEN 'extra' WHEN b.records > o.records THEN 'repeated' WHEN b.bytes < o.bytes THEN 'truncated' ELSE 'altered' END AS kind,
  coalesce(o.id, b.id) // {FILE} AS file, e - o.bytes AS start_offset, e AS end_offset, coalesce(b.bytes, 0) AS replica_bytes
FROM o FULL OUTER JOIN b USING (id) WHERE o.digest IS DISTINCT FROM b.digest"""
