"""Compression of vectors into codes of parts, learned on distinct parts.

1. Components become integers, floor(scale * x). A vector is cut into equal consecutive parts.
2. Equal parts at one position are one weighted row: there are as many rows as distinct parts, however
   often a part occurs, and copies collapse before the shuffle.
3. Weighted Lloyd rounds run over these rows. A task assigns its rows to the nearest entry and gives one
   sum for each entry it has met; the codebooks (parts * entries rows) are all that the driver sees.
4. Each distinct part's code and error are joined back to the vectors. Many copies of a vector make a
   skewed join, which adaptive execution splits.

Defined results: rows whose vector is null or has a null, infinite or NaN component are left out. A row
with a null id is coded, but is none of the first entries. Rows that share an id are each coded; the least
of their vectors counts where entries are chosen. Fewer ids than entries make a smaller codebook. Repeated
rows give repeated results; labels may be null and count as one label. An empty table gives an empty result.
Extra columns are ignored, whatever their names. Vectors of unequal lengths, or of one that the parts do not
divide, raise ValueError, as does a component of 2**40 or more after scaling: its square leaves 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, require

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of this size and more are refused.
LARGEST = 1 << 40
#: Components under this have squared distances that fit into 64 bits by far.
SMALL = 1 << 26


@dataclass
class Codebooks:
    """entries: (parts, entries, width) integers."""

    entries: np.ndarray

    def digest(self) -> str:
        """Of all components in order of part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, part: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the nearest entry (of ties the first) and the squared distance to it."""
        book = self.entries[part]
        if max(np.abs(rows).max(initial=0), np.abs(book).max(initial=0)) >= SMALL:
            rows, book = rows.astype(object), book.astype(object)
        far = ((rows[:, None, :] - book[None, :, :]) ** 2).sum(axis=2) if rows.shape[1] else np.zeros((len(rows), len(book)), dtype=np.int64)
        code = np.array([min(range(len(book)), key=d.__getitem__) for d in far.tolist()], dtype=np.int64) if far.dtype == object else far.argmin(axis=1)
        return code, far[np.arange(len(rows)), code]


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def integer_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """row (a number of its own), id, label, ints: of the usable rows, as a written table."""
    require(rows, id_col, vector_col, label_col)
    wide = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    ints = F.transform("vector", lambda x: F.floor(x * scale))
    return durable(wide.filter(_usable(F.col("vector"))).select(F.monotonically_increasing_id().alias("row"), "id", "label", ints.alias("ints")), "vectors")


def width_of(vectors: DataFrame, parts: int) -> int | None:
    """Components of a part; None without vectors."""
    sizes = vectors.agg(F.min(F.size("ints")), F.max(F.size("ints")), F.max(F.array_max(F.transform("ints", F.abs)))).first()
    if sizes[0] is None:
        return None
    if sizes[0] != sizes[1] or sizes[0] % parts:
        raise ValueError(f"vectors have {sizes[0]} to {sizes[1]} components; {parts} equal parts are wanted of each")
    if sizes[2] is not None and sizes[2] >= LARGEST:
        raise ValueError(f"a component of {sizes[2]} after scaling is too large")
    return sizes[0] // parts


def _parts_of(parts: int, width: int) -> Column:
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.alias("pos"), F.slice("ints", p * width + 1, width).alias("part")))
    return F.explode(cut).alias("cut")


def distinct_parts(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """pos, part, n: the distinct parts at each position and how many vectors have them, as a written table."""
    each = vectors.select(_parts_of(parts, width)).select("cut.pos", "cut.part")
    return durable(each.groupBy("pos", "part").agg(F.count(F.lit(1)).alias("n")), "parts")


def first_codebooks(vectors: DataFrame, parts: int, width: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids."""
    ids = [r[0] for r in vectors.filter("id is not null").select("id").distinct().orderBy("id").limit(entries).collect()]
    chosen = vectors.filter(F.col("id").isin(ids)).groupBy("id").agg(F.min("ints").alias("ints")).orderBy("id").collect()
    if not chosen:  # no row has an id: the least vectors
        chosen = vectors.select("ints").distinct().orderBy("ints").limit(entries).collect()
    rows = np.array([r["ints"] for r in chosen], dtype=np.int64).reshape(len(chosen), parts, width)
    return Codebooks(rows.transpose(1, 0, 2).copy())


def _by_position(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each position of a batch: the position, its rows, and their parts."""
    pos = batch.column("pos").to_numpy()
    flat = batch.column("part").flatten().to_numpy().reshape(batch.num_rows, width)
    for p in np.unique(pos).tolist():
        at = np.flatnonzero(pos == p)
        yield p, at, flat[at]


def lloyd_round(distinct: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry becomes the floor of its parts' weighted mean; entries without parts stay."""
    width = books.entries.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for batch in batches:
            n = batch.column("n").to_numpy()
            for p, at, rows in _by_position(batch, width):
                code, _ = books.nearest(p, rows)
                for e in np.unique(code).tolist():
                    own = at[code == e]
                    # Python's integers, so that sums of any size are right.
                    total = (rows[code == e].astype(object) * n[own].astype(object)[:, None]).sum(axis=0).tolist() if width else []
                    count, so_far = held.get((p, e), (0, [0] * width))
                    held[p, e] = (count + int(n[own].sum()), [a + b for a, b in zip(so_far, total, strict=True)])
        if held:
            keys = list(held)
            columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32())]
            columns += [pa.array([held[k][0] for k in keys], pa.int64()), pa.array([[str(x) for x in held[k][1]] for k in keys], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["pos", "entry", "n", "sums"])

    told = distinct.mapInArrow(sums, "pos int, entry int, n bigint, sums array<string>")
    each = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    new = books.entries.copy()
    # At most parts * entries rows.
    for r in told.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *each).collect():
        new[r["pos"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return Codebooks(new)


def coded_parts(distinct: DataFrame, books: Codebooks) -> DataFrame:
    """pos, part, code, error of the distinct parts."""
    width = books.entries.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=object)
            for p, at, rows in _by_position(batch, width):
                codes[at], errors[at] = books.nearest(p, rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("pos"), batch.column("part"), pa.array(codes.astype(np.int32)), pa.array(errors.tolist(), pa.int64())], names=["pos", "part", "code", "error"]
            )

    return distinct.mapInArrow(assign, "pos int, part array<bigint>, code int, error bigint")


def learn(vectors: DataFrame, distinct: DataFrame, width: int, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    books = first_codebooks(vectors, parts, width, entries)
    for _ in range(rounds):
        books = lloyd_round(distinct, books)
    return books


def compress(
    rows: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, codes, error) of each usable row, and the codebooks (None without rows)."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must lie between 1 and 256")
    vectors = integer_vectors(rows, id_col=id_col, vector_col=vector_col, label_col=label_col, scale=scale)
    width = width_of(vectors, parts)
    if width is None:
        none = vectors.select("id", "label", F.expr("cast(null as array<int>)").alias("codes"), F.lit(0).cast("long").alias("error"))
        return none, None
    distinct = distinct_parts(vectors, parts, width)
    books = learn(vectors, distinct, width, parts=parts, entries=entries, rounds=rounds)
    each = vectors.select("row", "id", "label", _parts_of(parts, width)).select("row", "id", "label", "cut.pos", "cut.part")
    found = each.join(coded_parts(distinct, books), ["pos", "part"])
    # A row has `parts` codes, so its list is short.
    own = found.groupBy("row", "id", "label").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("placed"), F.sum("error").alias("error"))
    return own.select("id", "label", F.col("placed.code").alias("codes"), "error"), books


def decompress(coded: DataFrame, books: Codebooks, *, codes_col: str = "codes", out_col: str = "ints") -> DataFrame:
    """coded with the integer vector that its codes stand for."""
    tables = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in part]) for part in books.entries])
    return coded.withColumn(out_col, F.flatten(F.transform(codes_col, lambda code, p: F.get(F.get(tables, p), code))))


def code_report(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **settings) -> DataFrame:
    """id, code (two hexadecimal digits a part), error, label_error (summed over rows of one label), codebooks_sha256."""
    coded, books = compress(rows, id_col=id_col, vector_col=vector_col, label_col=label_col, **settings)
    coded = durable(coded, "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), code.alias("code"), "error", "label_error", F.lit(books.digest() if books else "").alias("codebooks_sha256")
    )
