"""Near-duplicate documents by b-bit min-hash signatures, joined by a multi-index on signature chunks.

A signature has SLOTS min-hashes of 16 bits each. Its distance to another one is the number of slots that
differ. Of two signatures with a distance of at most `differences`, one of the chunks differs in at most
one slot (pigeonhole), so the two agree in one of SLOTS keys, each a chunk without one of its slots. The
signature threshold is far enough from the expected distance at the least similarity that a missed pair
is one in about 80,000, and every link is confirmed on the full shingle sets.

Who shares a key is never expanded into all pairs. Everyone is first compared with the best connected
member of the key. Only members of different components are compared then, in tiles of bounded size that
return a forest of links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domainlake.llm.common import map_slices, mix, spans_hash, text_bytes, word_hashes, words_of
from domainlake.llm.components import connected_components
from domainlake.operators.joins import lookup
from domainlake.session import written

SLOTS = 64
#: Members of one side of a tile: with signatures only, and with their texts (also at most so many shingles).
SIGNED, LOADED, LOADED_SHINGLES = 1024, 256, 1 << 21
_SET_BASE = 0xD1342543DE82EF95
_FACTORS = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def chunk_edges(differences: int) -> list[int]:
    """Borders of the chunks: one more than half of `differences`, so that one has at most one difference."""
    count = differences // 2 + 1
    return [SLOTS * k // count for k in range(count + 1)]


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of every text, ascending, one text after another, and their numbers.

    A text with fewer words has the whole sequence as its shingle; one without words has none.
    """
    data, starts, ends, first = words_of([t.lower() for t in texts])  # of bytes: ASCII letters only
    words = word_hashes(data, starts, ends)
    counts = np.diff(first)
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), n)
    begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[doc]
    hashes = spans_hash(words, begin, np.minimum(begin + shingle, first[doc + 1]))
    cuts = np.cumsum(n)
    sets = [np.unique(part) for part in np.split(hashes, cuts[:-1])] if len(texts) else []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if len(sets) else hashes), sizes


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SLOTS min-hashes of 16 bits for every set that isn't empty."""
    own = sizes[sizes > 0]
    out = np.empty((len(own), SLOTS), dtype=np.uint16)
    if len(own):
        starts = np.cumsum(own) - own
        for k in range(SLOTS):
            out[:, k] = mix(np.minimum.reduceat(hashes * _FACTORS[k], starts)) >> np.uint64(48)
    return out


def _set_ids(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of every whole set: equal sets have equal ids."""
    ends = np.cumsum(sizes)
    return spans_hash(hashes, ends - sizes, ends, _SET_BASE).view(np.int64)


def signed_rows(rows: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, uid, n_shingles, cls, sig) of every row of `rows(doc_id, uid, text)`; without words cls is null."""

    def work(batch):
        hashes, sizes = shingle_sets(text_bytes(batch.column("text")), shingle)
        some = sizes > 0
        cls, raw = np.zeros(len(sizes), dtype=np.int64), np.full(len(sizes), None, dtype=object)
        cls[some] = _set_ids(hashes, sizes)[some]
        raw[some] = [s.tobytes() for s in signatures(hashes, sizes)]
        columns = [batch.column("doc_id"), batch.column("uid"), pa.array(sizes), pa.array(cls, mask=~some)]
        columns.append(pa.array(raw.tolist(), pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "uid", "n_shingles", "cls", "sig"])

    return map_slices(rows, "text", work, "doc_id long, uid long, n_shingles long, cls long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a binary column without nulls, one in each row."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, SLOTS)


def keys(classes: DataFrame, differences: int) -> DataFrame:
    """(v, key, cls): for each slot v, the hash of its chunk's other slots."""
    edges = chunk_edges(differences)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                slots = _matrix(part.column("sig")).astype(np.uint64)
                out = np.empty((len(slots), SLOTS), dtype=np.uint64)
                for a, b in zip(edges, edges[1:]):
                    terms = mix((slots[:, a:b] + np.uint64(1)) * _FACTORS[a:b])
                    out[:, a:b] = mix(terms.sum(axis=1, keepdims=True) - terms)
                cls = part.column("cls").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(SLOTS, dtype=np.int8), len(cls))),
                        pa.array(out.reshape(-1).view(np.int64)),
                        pa.array(np.repeat(cls, SLOTS)),
                    ],
                    names=["v", "key", "cls"],
                )

    return classes.select("cls", "sig").mapInArrow(run, "v byte, key long, cls long")


def first_shared(differ: np.ndarray, differences: int) -> np.ndarray:
    """The first key that two signatures share, from a matrix of pairs and slots: does the slot differ?"""
    edges = chunk_edges(differences)
    best = np.full(len(differ), SLOTS)
    for a, b in reversed(list(zip(edges, edges[1:]))):
        own = differ[:, a:b]
        n = own.sum(axis=1)
        best = np.where(n == 0, a, np.where(n == 1, a + own.argmax(axis=1), best))
    return best


def _spread(column: str, count: str) -> Column:
    return F.pmod(F.xxhash64(column), F.col(count)).cast("int")


def tiles(members: DataFrame, most: int, most_shingles: int | None = None) -> DataFrame:
    """(v, key, i, j, side, cls, comp): members of each key dealt to tiles so that components meet.

    `members(v, key, cls, comp, n_shingles)`. Side 0 has block j of the members outside of the key's largest
    component, side 1 has block i of all members: every two members of different components meet in a tile,
    those of the largest one never with each other. Blocks hold about `most` members.
    """
    per = members.groupBy("v", "key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    whole = per.groupBy("v", "key").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "comp", "w")).alias("top"), F.count("*").alias("comps")
    )

    def blocks(n, w):
        count = F.ceil(n / most)
        return F.greatest(count, F.ceil(w / most_shingles), F.lit(1)) if most_shingles else F.greatest(count, F.lit(1))

    whole = whole.where("comps > 1").select(
        "v",
        "key",
        F.col("top.comp").alias("top"),
        blocks(F.col("n"), F.col("w")).alias("all_blocks"),
        blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("other_blocks"),
    )
    dealt = members.join(whole.hint("merge"), ["v", "key"])
    right = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("other_blocks") - 1).cast("int"))))
    left = dealt.where("comp <> top").withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("all_blocks") - 1).cast("int"))))
    columns = ["v", "key", "i", "j", "side", "cls", "comp"]
    return (
        right.withColumn("i", _spread("cls", "all_blocks")).withColumn("side", F.lit(1)).select(columns)
        .union(left.withColumn("j", _spread("cls", "other_blocks")).withColumn("side", F.lit(0)).select(columns))
    )


TILE = ["v", "key", "i", "j"]


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition(*TILE).sortWithinPartitions(*TILE, "side")


def _stretches(batch: pa.RecordBatch):
    """(tile, side, rows) of every stretch of one tile's side."""
    where = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*TILE, "side")], axis=1)
    cuts = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)]):
        if b > a:
            yield tuple(where[a, :4].tolist()), int(where[a, 4]), batch.slice(a, b - a)


def close_members(rows: DataFrame, differences: int) -> DataFrame:
    """(v, key, cls) of members of `rows` (tiles with sig) with a close one of another component in a tile.

    A pair that shares several keys counts in the first of them only.
    """

    def run(batches):
        tile, left = None, []
        for batch in batches:
            for at, side, part in _stretches(batch):
                if at != tile:
                    tile, left = at, []
                own = _matrix(part.column("sig")), part.column("comp").to_numpy(), part.column("cls").to_numpy()
                if side == 0:
                    left.append(own)
                    continue
                if len(left) > 1:
                    left = [tuple(np.concatenate(x) for x in zip(*left))]
                found = []
                for k in range(0, len(own[0]) if left else 0, 128):
                    sig, comp, cls = (x[k : k + 128] for x in own)
                    differ = sig[:, None, :] != left[0][0][None, :, :]
                    near = (differ.sum(axis=2) <= differences) & (comp[:, None] != left[0][1][None, :])
                    a, b = np.nonzero(near)
                    if len(a):
                        counts = first_shared(differ[a, b], differences) == tile[0]
                        found += [cls[a[counts]], left[0][2][b[counts]]]
                if found and len(cls := np.unique(np.concatenate(found))):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(cls), tile[0], dtype=np.int8)),
                            pa.array(np.full(len(cls), tile[1])),
                            pa.array(cls),
                        ],
                        names=["v", "key", "cls"],
                    )

    return _by_tile(rows).mapInArrow(run, "v byte, key long, cls long").distinct()


def confirmed_links(rows: DataFrame, shingle: int, percent: int, differences: int) -> DataFrame:
    """(a, b): links between side 0 and side 1 of every tile of `rows` (tiles with sig and z), as a forest.

    A link joins sets of different components whose signatures are close and whose intersection is at least
    `percent` hundredths of their union. Components that the tile has joined already aren't compared again, and
    a pair that shares several keys is compared in the first of them only.
    """

    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        tile, left, signs, root = None, [], None, {}

        def top(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                for at, side, part in _stretches(batch.slice(k, 64)):
                    if at != tile:
                        tile, left, signs, root = at, [], None, {}
                    hashes, sizes = shingle_sets([expand(z) for z in part.column("z").to_pylist()], shingle)
                    sets = np.split(hashes, np.cumsum(sizes)[:-1])
                    sig = _matrix(part.column("sig"))
                    cls, comp = part.column("cls").to_pylist(), part.column("comp").to_pylist()
                    if side == 0:
                        left += zip(cls, comp, sets)
                        signs = sig if signs is None else np.concatenate([signs, sig])
                        continue
                    if not left:
                        continue
                    differ = sig[:, None, :] != signs[None, :, :]
                    there = np.array([x[1] for x in left])
                    right, other = np.nonzero((differ.sum(axis=2) <= differences) & (np.array(comp)[:, None] != there[None, :]))
                    if at[0] >= 0:  # a slot's key, not a star
                        first = first_shared(differ[right, other], differences) == at[0]
                        right, other = right[first], other[first]
                    links = []
                    for n, m in zip(right.tolist(), other.tolist()):
                        a, b = top(comp[n]), top(left[m][1])
                        if a == b:
                            continue
                        small, large = sorted((sets[n], left[m][2]), key=len)
                        if 100 * len(small) < percent * len(large):
                            continue
                        place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                        both = int((large[place] == small).sum())
                        if 100 * both >= percent * (len(small) + len(large) - both):
                            root[max(a, b)] = min(a, b)
                            links.append((cls[n], left[m][0]))
                    if links:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*links)], names=["a", "b"])

    return _by_tile(rows).mapInArrow(run, "a long, b long")


def _close_pairs(pairs: DataFrame, classes: DataFrame, differences: int) -> DataFrame:
    """`pairs(hub, cls)` whose signatures are close."""
    own = classes.select("cls", "sig")
    rows = pairs.join(own.hint("merge"), "cls").join(own.toDF("hub", "hub_sig").hint("merge"), "hub")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = (_matrix(batch.column("sig")) != _matrix(batch.column("hub_sig"))).sum(axis=1) <= differences
                yield batch.select(["hub", "cls"]).filter(pa.array(near))

    return rows.select("hub", "cls", "sig", "hub_sig").mapInArrow(run, "hub long, cls long")


def _with_texts(rows: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """`rows(..., cls)` with signature and compressed text of their classes, one document's text for each."""
    wanted = rows.select("cls").distinct().join(classes.hint("merge"), "cls").select("cls", "doc_id", "uid", "sig")

    def work(batch):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        z = pa.array([squeeze(t) for t in text_bytes(batch.column("text"))], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("uid"), z], names=["doc_id", "uid", "z"])

    packed = map_slices(docs, "text", work, "doc_id long, uid long, z binary").dropDuplicates(["doc_id", "uid"])
    same = packed["doc_id"].eqNullSafe(wanted["doc_id"]) & (packed["uid"] == wanted["uid"])
    texts = packed.join(wanted.hint("merge"), same).select("cls", "sig", "z")
    return rows.join(texts.hint("merge"), "cls")


def class_links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int, differences: int) -> DataFrame:
    """(a, b): links between classes of equal sets that connect whatever similar sets connect."""
    rows = keys(classes, differences)
    spark = docs.sparkSession
    sizes = rows.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(rows.join(sizes.hint("merge"), ["v", "key"]), "shared-keys")
    # The best connected member of a key is the likely original of its copies.
    degree = shared.groupBy("cls").agg(F.sum("n").alias("degree"))
    hubs = shared.join(degree.hint("merge"), "cls").groupBy("v", "key").agg(F.max(F.struct("degree", "cls")).alias("hub"))
    hubs = hubs.select("v", "key", F.col("hub.cls").alias("hub"))
    pairs = shared.join(hubs.hint("merge"), ["v", "key"]).where("cls <> hub").select("hub", "cls").distinct()
    close = written(_close_pairs(pairs, classes, differences), "hub-pairs")
    weights = close.join(classes.select("cls", "n_shingles").hint("merge"), "cls").groupBy("hub")
    blocks = weights.agg(
        F.greatest(F.ceil(F.count("*") / LOADED), F.ceil(F.sum("n_shingles") / LOADED_SHINGLES)).alias("blocks")
    )
    dealt = close.join(blocks.hint("merge"), "hub").select(
        F.lit(-1).cast("byte").alias("v"), F.col("hub").alias("key"), _spread("cls", "blocks").alias("i"), F.lit(0).alias("j"),
        F.lit(1).alias("side"), "cls", F.col("cls").alias("comp"),
    )
    hub_rows = dealt.select("v", "key", "i", "j").distinct().select(
        "v", "key", "i", "j", F.lit(0).alias("side"), F.col("key").alias("cls"), F.col("key").alias("comp")
    )
    stars = _with_texts(dealt.union(hub_rows), classes, docs)
    links = written(confirmed_links(stars, shingle, percent, differences), "hub-links")
    linked = connected_components(links).toDF("cls", "comp")
    weighed = shared.select("v", "key", "cls").join(classes.select("cls", "n_shingles").hint("merge"), "cls")
    members = weighed.join(linked.hint("merge"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    members = written(members, "members")
    signed = tiles(members, SIGNED).join(classes.select("cls", "sig").hint("merge"), "cls")
    near = close_members(signed, differences).join(members.hint("merge"), ["v", "key", "cls"])
    near = written(near, "close-members")
    rest = _with_texts(tiles(near, LOADED, LOADED_SHINGLES), classes, docs)
    return links.union(written(confirmed_links(rest, shingle, percent, differences), "links"))


def min_hash_components(docs: DataFrame, shingle: int = 3, percent: int = 85, differences: int = 23) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs(doc_id, text)`.

    A document's set has its distinct word shingles, ASCII letters in lower case; with fewer words, the whole
    sequence. Documents are linked where 100 * intersection >= percent * union, found where at most
    `differences` of the SLOTS min-hashes differ (at 85 percent all but one pair in about 80,000; the default
    suits no smaller share). component_id is the smallest doc_id that can be reached over links, kept is
    true for rows with that id. A null text, an empty one and one without words have an empty set and are
    linked with nothing. Rows with equal doc_id are separate documents; a null doc_id is never the smallest
    unless a component has no other, and component_id is null then. An empty table gives an empty table;
    other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("uid", F.xxhash64("text"))
    signed = written(signed_rows(rows, shingle), "signatures")
    # Min-hashes are equal for equal sets, so any row stands for its class.
    some = signed.where("cls is not null").groupBy("cls")
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "uid")
    classes = some.agg(F.min(first).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = written(classes.select("cls", "first.doc_id", "first.uid", "n_shingles", "sig"), "classes")
    linked = connected_components(class_links(rows, classes, shingle, percent, differences)).toDF("cls", "root")
    rooted = written(
        classes.select("cls", "doc_id").join(linked.hint("merge"), "cls", "left").withColumn("root", F.coalesce("root", "cls")),
        "rooted",
    )
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    component = rooted.join(least.hint("merge"), "root").select("cls", "least")
    found = lookup(signed.select("doc_id", "n_shingles", "cls"), component, "cls")
    component_id = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return found.select(
        "doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept")
    )
