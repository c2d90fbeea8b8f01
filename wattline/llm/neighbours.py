"""Near duplicates among embeddings: inverted lists with product quantisation, reranked by exact cosine.

Vectors are compared at length one, where a cosine of at least c is a distance of at most r = sqrt(2 - 2c). A coarse
quantiser puts each into the list of its nearest centre; what is left is coded by parts, each part by its nearest code word, and
the length of what the code misses is stored with it.

* Probes suffice: a vector within r of the query, in the list of another centre, cannot lie further than r beyond the
  plane half-way between the two centres. So a query visits exactly the lists whose plane is within r.
* Tables suffice: the distance from the query to the coded vector comes from one table look-up per part. It is off by no
  more than what the code misses, so a vector is a candidate if its table distance is at most r plus that.

Every linked pair thus becomes a candidate, whatever the centres and codes are (recall is 1, not a matter of luck); the exact cosine in double
precision decides. Equal vectors are searched once and counted as often as they occur. Neighbouring lists make a region; a query travels
once to each region where it visits a list, and its table of products with the code words serves all lists there. Regions are dealt into
blocks of bounded size, and a block hands on its counts and one root per vector, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.lineage import spread, stage
from wattline.llm.components import components
from wattline.llm.tables import ROW

COSINE, LISTS, PER_LIST, PARTS, WORDS, BLOCK, SLACK = 0.95, 4096, 32, 8, 256, 2048, 1e-4
#: Lists of a region, about; queries in a block and at once; what single precision may add to a squared table distance, and more.
PER_REGION, ASKING, AT_ONCE, ROUNDING = 8, 8192, 128, 1e-5


@dataclass(frozen=True)
class Index:
    """Centres, and code words by part; ``width`` components, filled up with zeros to a multiple of the parts; the region of each centre, ascending."""

    centres: np.ndarray
    words: np.ndarray
    width: int
    region: np.ndarray

    def cut(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), len(self.words), -1)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the squared distances to all."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    return d.argmin(1), np.maximum(d, 0)


def means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres of k groups; empty groups keep their old centre."""
    rng = np.random.default_rng(7)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = np.concatenate([nearest(x[i : i + 4096], centres)[0] for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def matrix(column, width: int) -> np.ndarray:
    """Vectors of length one in double precision, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(lists), width))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(offsets)
    if len(size) and (size == size[0]).all():
        out[:, : size[0]] = flat[offsets[0] : offsets[-1]].reshape(len(lists), size[0])
    else:
        for i, (a, z) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            out[i, : z - a] = flat[a:z]
    # a tiny or huge vector is scaled by its largest component first
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def fit(vectors: DataFrame, n: int, width: int, column: str = "embedding", lists: int | None = None, parts: int = PARTS) -> Index:
    """An index fitted on a sample of at most LISTS * PER_LIST vectors, chosen by a hash of their row."""
    k = min(LISTS, lists or max(1, round(math.sqrt(n))))
    share = min(1.0, k * PER_LIST / max(n, 1))
    sample = vectors.where(F.pmod(F.xxhash64(F.lit(11), ROW), F.lit(1_000_000)) < math.ceil(1_000_000 * share)).limit(LISTS * PER_LIST)
    x = matrix(sample.select(column).toArrow().column(0), width)
    if not len(x):
        x = np.eye(1, width)
    centres = means(x, min(k, len(x)))
    region = nearest(centres, means(centres, -(-len(centres) // PER_REGION)))[0]
    centres, region = centres[np.argsort(region, kind="stable")], np.sort(region)
    rest = x - centres[nearest(x, centres)[0]]
    cut = rest.reshape(len(x), parts, -1)
    words = [means(np.ascontiguousarray(cut[:, p]), min(WORDS, len(x))) for p in range(parts)]
    return Index(centres, np.stack(words), width, region)


def visits(lists: np.ndarray, home: np.ndarray, own: np.ndarray, d: np.ndarray, between: np.ndarray, reach: float) -> np.ndarray:
    """Which of the lists each vector visits: those whose plane is within reach, none after its own.

    ``own`` and ``d`` are squared distances to its own and to these lists' centres, ``between`` those of its own centre to theirs.
    """
    between = np.sqrt(between)
    with np.errstate(divide="ignore", invalid="ignore"):
        beyond = np.where(between > 0, (d - own[:, None]) / (2 * between), 0.0)
    return (beyond <= reach + SLACK) & (lists <= home[:, None])


def coded(vectors: DataFrame, index: Index, reach: float) -> DataFrame:
    """Each vector once as a member of its list's region, with list, code and miss, and once per region where it visits a list.

    Of two lists only the later visits the earlier, so a pair meets once.
    """
    between, every = nearest(index.centres, index.centres)[1], np.arange(len(index.centres))
    regions, first = np.unique(index.region, return_index=True)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                x = matrix(batch.column("embedding"), index.width)
                home, d = nearest(x, index.centres)
                rest = index.cut(x - index.centres[home])
                codes = np.stack([nearest(rest[:, p], w)[0] for p, w in enumerate(index.words)], axis=1)
                told = np.stack([w[codes[:, p]] for p, w in enumerate(index.words)], axis=1)
                miss = np.sqrt(((rest - told) ** 2).sum(axis=(1, 2)))
                who, where = np.nonzero(np.logical_or.reduceat(visits(every, home, d.min(axis=1), d, between[home], reach), first, axis=1))
                take = np.concatenate([np.arange(len(x)), who])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([index.region[home], regions[where]]).astype(np.int32)), pa.array(np.arange(len(take)) >= len(x)), pa.array(home[take].astype(np.int32)), batch.column(ROW).take(pa.array(take)), batch.column("copies").take(pa.array(take)),
                    pa.array([*(c.astype(np.uint8).tobytes() for c in codes), *[b""] * len(who)], pa.binary()), pa.array(np.concatenate([miss, np.zeros(len(who))])), batch.column("embedding").take(pa.array(take)),
                ], names=["region", "asks", "home", ROW, "copies", "code", "miss", "embedding"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.mapInArrow(code, f"region int, asks boolean, home int, {ROW} long, copies long, code binary, miss double, embedding {kind}")


def searched(rows: DataFrame, index: Index, cosine: float) -> DataFrame:
    """For every vector and block in which it has links: row, n (vectors linked) and root (smallest row joined to it there)."""
    reach = math.sqrt(2 - 2 * cosine)
    sizes = rows.groupBy("region").agg(F.count_if(~F.col("asks")).alias("m"), F.count_if("asks").alias("q"))
    sizes = sizes.selectExpr("region", f"greatest(1, CAST(ceil(m / {BLOCK}) AS INT)) AS mb", f"greatest(1, CAST(ceil(q / {ASKING}) AS INT)) AS qb")
    dealt = rows.join(F.broadcast(stage(sizes, "regions")), "region")  # LISTS rows at most
    dealt = dealt.withColumn("i", F.expr(f"explode(if(asks, sequence(0, mb - 1), array(CAST(pmod(xxhash64({ROW}), mb) AS INT))))"))
    dealt = dealt.withColumn("j", F.expr(f"explode(if(asks, array(CAST(pmod(xxhash64({ROW}, 3), qb) AS INT)), sequence(0, qb - 1)))")).drop("mb", "qb")

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy().astype(bool)
        row, copies, miss, home = (table.column(c).to_numpy() for c in (ROW, "copies", "miss", "home"))
        dims = np.diff(table.column("embedding").combine_chunks().offsets.to_numpy())
        x = matrix(table.column("embedding"), index.width)
        members, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
        code = np.frombuffer(b"".join(table.column("code").filter(pa.array(~asks)).to_pylist()), np.uint8).reshape(len(members), len(index.words))
        n, label = np.zeros(len(row), np.int64), np.arange(len(row))
        # members and queries list by list, so few of those at once visit few lists
        by = np.argsort(home[members], kind="stable")
        members, code = members[by], code[by]
        queries = queries[np.argsort(home[queries], kind="stable")]
        lists, begin = np.unique(home[members], return_index=True)
        end = np.append(begin[1:], len(members))
        centres = index.centres[lists]
        between = nearest(centres, index.centres)[1].T
        # what a coded vector is away from a query, squared: the query from the centre, the code's own share, and twice the products of parts
        told = np.concatenate([w[code[:, p]] for p, w in enumerate(index.words)], axis=1)
        share = (2 * (told * index.centres[home[members]]).sum(1) + (told * told).sum(1)).astype(np.float32)
        most = ((reach + SLACK + miss[members]) ** 2 + ROUNDING - share).astype(np.float32)
        for at in range(0, len(queries) if len(members) else 0, AT_ONCE):
            q = queries[at : at + AT_ONCE]
            d, own = nearest(x[q], centres)[1], ((x[q] - index.centres[home[q]]) ** 2).sum(axis=1)
            visited = visits(lists, home[q], own, d, between[home[q]], reach).any(axis=0)
            tables = np.stack([2 * w @ part.T for w, part in zip(index.words, index.cut(x[q]).swapaxes(0, 1), strict=True)]).astype(np.float32)
            d = d.T.astype(np.float32)
            found = []
            for one in np.flatnonzero(visited):
                at_list = slice(begin[one], end[one])
                far = d[one] - tables[0][code[at_list, 0]]
                for p in range(1, len(tables)):
                    far -= tables[p][code[at_list, p]]
                b, a = np.nonzero(far <= most[at_list, None])
                found.append((a, b + begin[one]))
            if not found:
                continue
            a, b = (np.concatenate(side) for side in zip(*found, strict=True))
            # within its own list a pair meets twice; it counts from the later row
            a_row, b_row = q[a], members[b]
            ok = ((home[a_row] > home[b_row]) | ((home[a_row] == home[b_row]) & (row[a_row] > row[b_row]))) & (dims[a_row] == dims[b_row])
            a_row, b_row = a_row[ok], b_row[ok]
            exact = np.einsum("ij,ij->i", x[a_row], x[b_row]) >= cosine
            a_row, b_row = a_row[exact], b_row[exact]
            np.add.at(n, a_row, copies[b_row])
            np.add.at(n, b_row, copies[a_row])
            order = np.argsort(a_row, kind="stable")
            a_row, b_row = a_row[order], b_row[order]
            cuts = np.flatnonzero(np.diff(a_row)) + 1
            for linked, asker in zip(np.split(b_row, cuts), a_row[np.concatenate([[0], cuts])] if len(a_row) else [], strict=False):
                old = np.unique(label[np.append(linked, asker)])
                if len(old) > 1:
                    label[np.isin(label, old)] = old[0]
        # a vector may stand here twice, as member and as query: both are joined through the row
        smallest = np.full(len(row), np.iinfo(np.int64).max)
        np.minimum.at(smallest, label, row)
        out = n > 0
        return pa.table({ROW: pa.array(row[out]), "n": pa.array(n[out]), "root": pa.array(smallest[label[out]])})

    return dealt.groupBy("region", "i", "j").applyInArrow(search, f"{ROW} long, n long, root long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, key: str = "vec_id", column: str = "embedding", lists: int | None = None) -> DataFrame:
    """Every vector with key, n_links, component_id and kept.

    ``n_links`` counts the other vectors with a cosine of ``cosine`` or more, ``component_id`` is the smallest key that
    links lead to, ``kept`` says that it is the vector's own. Vectors that are null, empty or zero, or hold a component that is null or not finite,
    link with nothing; vectors of different length don't link. Equal vectors link. Every row stays, also with a
    null key (never kept, unless all its component has null keys) or a repeated one. Other columns are ignored; an empty table gives none.
    """
    # single precision stays as it is; all else is compared as doubles
    kind = "float" if embeddings.schema[column].dataType.simpleString() == "array<float>" else "double"
    all_ = embeddings.select(F.col(f"`{key}`").alias(key), F.col(f"`{column}`").cast(f"array<{kind}>").alias("embedding")).withColumn(ROW, F.monotonically_increasing_id())
    all_ = stage(all_, "vectors")
    sound = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < CAST('Infinity' AS DOUBLE)) AND exists(embedding, x -> x <> 0)"
    good = all_.where(f"coalesce({sound}, false)")
    kinds = stage(good.groupBy("embedding").agg(F.min(ROW).alias(ROW), F.count("*").alias("copies")), "distinct")
    n, longest = kinds.agg(F.count("*"), F.max(F.size("embedding"))).first()
    width = PARTS * -(-(longest or 1) // PARTS)
    index = fit(kinds, n, width, lists=lists)
    found = stage(searched(stage(coded(spread(kinds, ROW), index, math.sqrt(2 - 2 * cosine)), "coded"), index, cosine), "found")
    links = found.groupBy(ROW).agg(F.sum("n").alias("n"))
    tree = components(found.select(F.col(ROW).alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "_at"})
    classes = kinds.join(links, ROW, "left").join(tree, F.col(ROW) == F.col("_at"), "left")
    classes = classes.select("embedding", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", ROW).alias("root"))
    placed = good.join(classes, "embedding").select(key, ROW, "n_links", "root").union(all_.where(f"NOT coalesce({sound}, false)").select(key, ROW, F.lit(0).cast("long"), ROW))
    placed = stage(placed, "placed")
    smallest = placed.groupBy("root").agg(F.min(key).alias("component_id"))
    return placed.join(smallest, "root").select(key, "n_links", "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept"))
