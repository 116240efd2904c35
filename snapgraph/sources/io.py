"""Graph files: adjacency text, byte and block-byte binaries; generators; byte ranges of text."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from snapgraph.functions.cuts import cut, scanned, with_rank
from snapgraph.functions.hashing import ith_rand
from snapgraph.plans.graph import Graph
from snapgraph.sources import codec

HEADER = "AdjacencyGraph"


def read_csr(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """The vertex count and the raw edges (place, src, dst) of a text file, as they stand there: self loops and repeats too.

    Text: the header token, n, m, n offsets, m neighbour ids, white space between.

    Tokens get global places from per-line counts, so the file is read in splits;
    an edge's source is the last vertex whose offset is not past the edge's place.
    Spark deals splits by size, so lines are ordered by the place of their split first.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"), "value")
    folder, part = F.regexp_extract("file", "^(.*)/", 1), F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).try_cast("long")
    # One row for each split: so few that one task numbers them.
    splits = cut(lines.select("file", "at").distinct().withColumn("split", F.row_number().over(W.orderBy(folder, part, "file", "at"))))
    words = cut(lines.join(F.broadcast(splits), ["file", "at"]).select("split", "line", F.filter(F.split("value", r"\s+"), lambda w: w != "").alias("w")).where("size(w) > 0"))
    spread = with_rank(words.select("split", "line", F.posexplode("w").alias("k", "word")), "split", "line", "k", name="pos")
    spread = cut(spread.select("pos", "word"))
    head = {r["pos"]: r["word"] for r in spread.where("pos < 3").collect()}
    if head.get(0) != HEADER:
        raise ValueError(f"{path} does not begin with {HEADER}")
    n, m = int(head[1]), int(head[2])
    offsets = spread.where((F.col("pos") >= 3) & (F.col("pos") < 3 + n)).select((F.col("pos") - 3).alias("id"), F.col("word").cast("long").alias("start"))
    targets = spread.where((F.col("pos") >= 3 + n) & (F.col("pos") < 3 + n + m)).select((F.col("pos") - 3 - n).alias("place"), F.col("word").cast("long").alias("dst"))
    ends = offsets.select((F.col("id") - 1).alias("id"), F.col("start").alias("end"))
    lists = offsets.join(ends, "id", "left").select("id", "start", F.coalesce("end", F.lit(m)).alias("end")).where("end > start")
    edges = lists.select(F.col("id").alias("src"), F.explode(F.sequence("start", F.col("end") - 1)).alias("place")).join(targets, "place").select("place", "src", "dst")
    return n, edges


def read_adjacency(spark: SparkSession, path: str) -> Graph:
    n, edges = read_csr(spark, path)
    return Graph.from_edges(edges, spark.range(n).toDF("id"))


def write_adjacency(g: Graph, path: str) -> None:
    """One text file set in the same format: header, offsets, targets, in order."""
    n = g.num_vertices().first()["n"]
    m = g.edges.count()
    spark = g.edges.sparkSession
    every = Graph(spark.range(n).toDF("id"), g.edges)
    offsets = scanned(every.degrees(), ["id"], {"start": (F.col("degree"), "sum")}, inclusive=False).select((F.col("id") + 3).alias("pos"), F.col("start").cast("string").alias("value"))
    targets = every.retrieve_edges().select((F.col("pos") + 3 + n).alias("pos"), F.col("dst").cast("string").alias("value"))
    head = spark.createDataFrame([(0, HEADER), (1, str(n)), (2, str(m))], "pos long, value string")
    head.union(offsets).union(targets).orderBy("pos").select("value").write.text(path)


def _coded(g: Graph, blocks: bool) -> DataFrame:
    """(id, cell, degree) for every id from 0 to the largest, encoded where the lists are."""
    n = g.num_vertices().first()["n"]
    lists = g.edges.sparkSession.range(n).join(g.adjacency(), "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<long>")).alias("nbrs"))

    def run(batches):
        for batch in batches:
            ids, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cells = [(codec.encode_blocks if blocks else codec.encode)(v, n) for v, n in zip(ids, own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary()), pa.array([len(n) for n in own], pa.int64())], names=["id", "cell", "degree"])

    return lists.mapInArrow(run, "id long, cell binary, degree long")


def write_compressed(g: Graph, path: str, blocks: bool = False) -> None:
    """One binary file: n, m, size (i64), n+1 byte offsets (u64), n degrees (u32), codes.

    The codes are made by the executors; the driver only passes on a partition at a time, as one file has one writer.
    """
    spark = g.edges.sparkSession
    cells = cut(scanned(_coded(g, blocks).withColumn("size", F.length("cell").cast("long")), ["id"], {"start": (F.col("size"), "sum")}, inclusive=False))
    n, m, total = cells.agg(F.count(F.lit(1)), F.coalesce(F.sum("degree"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ordered = cells.orderBy("id")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(struct.pack("<qqq", n, m, total)))
        for column, kind in (("start", "<Q"), ("degree", "<I"), ("cell", None)):
            held = bytearray()
            for (value,) in ordered.select(column).toLocalIterator():
                held += value if kind is None else struct.pack(kind, value)
                if len(held) > 1 << 20:
                    out.write(held)
                    held = bytearray()
            out.write(held + (struct.pack("<Q", total) if column == "start" else b""))
    finally:
        out.close()


#: Schemes that pyarrow reads by range; files of other stores are read whole by Spark, up to the 2 GB of one cell.
RANGED = ("file", "hdfs", "s3", "gs")


def read_compressed(spark: SparkSession, path: str, fmt: str = "byte", parts: int = 8) -> Graph:
    """Binary of either layout, ``byte`` or ``bytepda``: each of the parts reads its range of vertices, and only its bytes.

    Self loops and repeats go.  Raises if the degrees do not add up to the edge count.
    """
    if fmt not in ("byte", "bytepda"):
        raise ValueError(fmt)
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(named).toString()
    scheme = uri.split(":")[0]
    uri = uri.replace("file:/", "file:///", 1) if scheme == "file" and not uri.startswith("file://") else uri

    def piece(at: int, size: int) -> bytes:
        import pyarrow.fs as pafs

        system, name = pafs.FileSystem.from_uri(uri)
        with system.open_input_file(name) as f:
            f.seek(at)
            return f.read(size)

    def ranges(part: int, read) -> tuple:
        """First vertex, degrees, edges of the part's vertices; read gives (offset, size) of the file."""
        n, m, _ = struct.unpack("<qqq", read(0, 24))
        low, high = n * part // parts, n * (part + 1) // parts
        offsets = struct.unpack(f"<{high - low + 1}Q", read(24 + 8 * low, 8 * (high - low + 1)))
        degrees = struct.unpack(f"<{high - low}I", read(24 + 8 * (n + 1) + 4 * low, 4 * (high - low)))
        return (n, m), low, offsets, degrees, read(24 + 12 * n + 8 + offsets[0], offsets[-1] - offsets[0])

    def decoded(part: int, read):
        sizes, low, offsets, degrees, codes = ranges(part, read)
        src, dst = [], []
        for k, degree in enumerate(degrees):
            cell = codes[offsets[k] - offsets[0] : offsets[k + 1] - offsets[0]]
            own = codec.decode(low + k, degree, cell)[0] if fmt == "byte" else codec.decode_blocks(low + k, cell)
            src += [low + k] * len(own)
            dst += own
            if len(src) > 1 << 16:
                yield src, dst, 0, sizes
                src, dst = [], []
        yield src, dst, sum(degrees), sizes

    def batches_of(part: int, read):
        for src, dst, total, (n, m) in decoded(part, read):
            # A row without an edge tells the part's sum of degrees.
            yield pa.RecordBatch.from_arrays([pa.array([*src, None], pa.int64()), pa.array([*dst, None], pa.int64()), pa.array([None] * len(src) + [total], pa.int64()), pa.array([None] * len(src) + [m], pa.int64()), pa.array([None] * len(src) + [n], pa.int64())], names=["src", "dst", "total", "m", "n"])

    schema = "src long, dst long, total long, m long, n long"
    if scheme in RANGED:

        def run(batches):
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    yield from batches_of(part, piece)

        cells = spark.range(0, parts, 1, parts).mapInArrow(run, schema)
    else:

        def run(batches):
            for batch in batches:
                for content in batch.column(0):
                    whole = memoryview(content.as_buffer())
                    for part in range(parts):
                        yield from batches_of(part, lambda at, size: bytes(whole[at : at + size]))

        cells = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
    cells = cut(cells)
    told = cells.where("total is not null").agg(F.sum("total").alias("total"), F.max("m").alias("m"), F.max("n").alias("n")).first()
    if told["total"] != told["m"]:
        raise ValueError("the degrees do not add up to the edge count")
    edges = cells.where("src is not null and src <> dst").select("src", "dst")
    return Graph.from_edges(edges, spark.range(told["n"]).toDF("id"))


def load(spark: SparkSession, path: str, fmt: str = "adjacency", parts: int = 8) -> Graph:
    return read_adjacency(spark, path) if fmt == "adjacency" else read_compressed(spark, path, fmt, parts)


def rmat(spark: SparkSession, n: int, m: int, seed: int = 0, a: float = 0.5, b: float = 0.1, c: float = 0.1, compat: bool = False) -> DataFrame:
    """(i, src, dst): edge i of the recursive-matrix generator over n = 2^k vertices; every level takes a quadrant by an own random number.

    compat halves the effective quadrant shares, as a generator does whose random numbers reach 2.
    """
    if n < 1 or n & (n - 1):
        raise ValueError("n must be a power of two")
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for level in range(n.bit_length() - 1):
        r = ith_rand(F.col("i") * F.lit(n.bit_length()) + level, seed).cast("double") / F.lit(2147483648.0 if compat else 4294967296.0)
        src = src * 2 + F.when(r >= a + b, 1).otherwise(0)
        dst = dst * 2 + F.when(((r >= a) & (r < a + b)) | (r >= a + b + c), 1).otherwise(0)
    return spark.range(m).select(F.col("id").alias("i")).select("i", src.alias("src"), dst.alias("dst"))


def sql_rmat(n: int, m: int, seed: int = 0, a: float = 0.5, b: float = 0.1, c: float = 0.1) -> str:
    """The same edges in SQL."""
    src, dst = "0::BIGINT", "0::BIGINT"
    for level in range(n.bit_length() - 1):
        src, dst = f"({src})*2 + CASE WHEN r{level} >= {a + b} THEN 1 ELSE 0 END", f"({dst})*2 + CASE WHEN (r{level} >= {a} AND r{level} < {a + b}) OR r{level} >= {a + b + c} THEN 1 ELSE 0 END"
    steps = ["s0 AS (SELECT range AS i FROM range(%d))" % m]
    for level in range(n.bit_length() - 1):
        steps.append(f"p{level} AS (SELECT *, ((i * {n.bit_length()} + {level} + {seed}) * 2654435761) % 4294967296 AS x FROM s{level})")
        steps.append(f"q{level} AS (SELECT * REPLACE ((xor(x, x >> 15) * 73244475) % 4294967296 AS x) FROM p{level})")
        steps.append(f"t{level} AS (SELECT * EXCLUDE (x), ((xor(x, x >> 13) * 41211551) % 4294967296)::DOUBLE / 4294967296.0 AS r{level} FROM q{level})")
        steps.append(f"s{level + 1} AS (SELECT * FROM t{level})")
    return f"WITH {', '.join(steps)} SELECT i, ({src})::BIGINT AS src, ({dst})::BIGINT AS dst FROM s{n.bit_length() - 1}"


def characters(docs: DataFrame, text: str = "text", start: int = 0, end: int | None = None) -> DataFrame:
    """(doc, idx, val): code points of a range of each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    part = F.substring(t, F.lit(start + 1), (F.lit(end) if end is not None else F.char_length(t)) - start)
    return docs.select("doc_id", F.posexplode(F.filter(F.split(part, ""), lambda c: c != "")).alias("idx", "val"))


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def random_sources(g: Graph, count: int, seed: int = 0) -> DataFrame:
    """(query, id): vertices picked by a counter-based generator."""
    n = g.edges.sparkSession.range(1).join(g.num_vertices()).select("n")
    return g.edges.sparkSession.range(count).toDF("query").join(F.broadcast(n)).select("query", F.pmod(ith_rand(F.col("query"), seed), F.col("n")).alias("id"))
