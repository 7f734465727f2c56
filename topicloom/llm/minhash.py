"""Near-duplicates by circulant MinHash, banding and exact Jaccard similarity."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.store import written
from topicloom.llm.words import Words, flat, give_back, mix, ngrams, slices
from topicloom.operators.components import connected_components
from topicloom.operators.skew import frequent_keys, salted_join

#: Words of a shingle, and the similarity of a link in hundredths.
SHINGLE = 5
PERCENT = 85
#: Coordinates of a signature, and of a band at most. A pair of similarity 0.85 shares none of 42 bands
#: of 6 with probability (1 - 0.85 ** 6) ** 42 = 2e-9; lower similarities have shorter bands where
#: the probability were above ``MISSED``.
COORDINATES = 252
ROWS = 6
MISSED = 1e-5
#: Size of the permuted universe, a power of two.
UNIVERSE = 1 << 22
#: Standard errors below the threshold from which an estimate rules a pair out.
DEVIATIONS = 6.0
#: Members of a bucket that are compared in one piece.
PIECE = 1024

SIGNATURES = "id long, n long, d1 long, d2 long, bands array<long>, sketch binary"
SIGNATURE_SCHEMA = pa.schema(
    [
        ("id", pa.int64()),
        ("n", pa.int64()),
        ("d1", pa.int64()),
        ("d2", pa.int64()),
        ("bands", pa.list_(pa.int64())),
        ("sketch", pa.binary()),
    ]
)


def band_rows(percent: int) -> int:
    """Coordinates of a band for pairs of this similarity: as many as miss few enough of them."""
    for rows in range(ROWS, 0, -1):
        missed = (1 - (percent / 100) ** rows) ** (COORDINATES // rows)
        if COORDINATES % rows == 0 and missed <= MISSED:
            return rows
    raise ValueError(f"pairs of similarity {percent / 100} share too few of {COORDINATES} coordinates")


@functools.cache
def _circulant() -> np.ndarray:
    """The second permutation, prolonged so that every shift of it is a window.

    Row ``x`` holds its values at ``x``, ``x - 1``, ... ``x - COORDINATES + 1`` around the circle.
    """
    table = np.random.default_rng(7).permutation(UNIVERSE).astype(np.int32)
    prolonged = np.concatenate([table[UNIVERSE - COORDINATES + 1 :], table])
    return np.lib.stride_tricks.sliding_window_view(prolonged, COORDINATES)


def _scattered(shingles: np.ndarray) -> np.ndarray:
    """The first permutation: places of the shingles in the universe, by a bijection of it."""
    place = (shingles >> np.uint64(42)).astype(np.int64)
    return (place * 0x2C1B3C6D + 0x297A2D39) % UNIVERSE


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted by text and value, and how many each text has.

    A text of fewer words has one, all of them in a row; a text without words has none.
    """
    hashes = words.hashes(lower=True)
    owner = words.text_of_word()
    total = len(hashes)
    grams = ngrams(hashes, size)
    left = np.repeat(words.first[1:], words.counts) - np.arange(total)
    whole = np.flatnonzero(left >= size)
    values, texts = grams[whole], owner[whole]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        alone = [
            ngrams(hashes[words.first[t] : words.first[t + 1]], int(words.counts[t]))[0]
            + np.uint64(words.counts[t])
            for t in short
        ]
        values = np.concatenate([values, mix(np.array(alone, np.uint64))])
        texts = np.concatenate([texts, short])
    order = np.lexsort((values, texts))
    values, texts = values[order], texts[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
    return values[new], np.bincount(texts[new], minlength=len(words.counts))


def signatures(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All coordinates of each text that has shingles, in the order of the texts."""
    circulant = _circulant()
    full = counts[counts > 0]
    ends = np.cumsum(full)
    owner = np.repeat(np.arange(len(full)), full)
    places = _scattered(shingles)
    found = np.full((len(full), COORDINATES), UNIVERSE, np.int32)
    step = 1 << 14
    for begin in range(0, int(ends[-1]) if len(ends) else 0, step):
        part = circulant[places[begin : begin + step]]
        who = owner[begin : begin + step]
        starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        least = np.minimum.reduceat(part, starts, axis=0)
        found[who[starts]] = np.minimum(found[who[starts]], least)
    return found


def _signed(ids: pa.Array, words: Words, rows: int) -> pa.RecordBatch:
    number = COORDINATES // rows
    values, counts = shingle_sets(words)
    has = counts > 0
    found = signatures(values, counts)
    starts = (np.cumsum(counts) - counts)[has]
    digests = np.zeros((2, len(counts)), np.uint64)
    if len(starts):
        for i, salt in enumerate((0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)):
            digests[i, has] = np.add.reduceat(mix(values ^ np.uint64(salt)), starts)
    bands = np.zeros((len(found), number), np.uint64)
    parts = found.reshape(len(found), number, rows).astype(np.uint64)
    for i in range(rows):
        bands = mix(bands + parts[:, :, i] + np.arange(number, dtype=np.uint64) * np.uint64(i == 0))
    sketch = (mix(found.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
    places = np.concatenate([[0], np.cumsum(np.where(has, number, 0))]).astype(np.int32)
    sizes = np.concatenate([[0], np.cumsum(np.where(has, COORDINATES, 0))]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(counts.astype(np.int64)),
            pa.array(digests[0].view(np.int64)),
            pa.array(digests[1].view(np.int64)),
            pa.ListArray.from_arrays(pa.array(places), pa.array(bands.ravel().view(np.int64))),
            pa.Array.from_buffers(
                pa.binary(), len(counts), [None, pa.py_buffer(sizes.tobytes()), pa.py_buffer(sketch.tobytes())]
            ),
        ],
        schema=SIGNATURE_SCHEMA,
    )


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))


def sign(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Number of shingles, digest of the set, band keys and a sketch of each text."""
    rows = band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for begin, end in slices(offsets):
                cut = offsets[begin : end + 1]
                words = Words(data[cut[0] : cut[-1]], cut - cut[0])
                yield _signed(batch.column(0).slice(begin, end - begin), words, rows)
            give_back()

    return _texts(docs, id, text).mapInArrow(run, SIGNATURES)


def _sets(texts: DataFrame) -> DataFrame:
    """``(id, shingles)``: the sorted full sets as binaries of 64-bit values."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for begin, end in slices(offsets):
                cut = offsets[begin : end + 1]
                values, counts = shingle_sets(Words(data[cut[0] : cut[-1]], cut - cut[0]))
                ends = (8 * np.cumsum(counts)).tolist()
                raw = values.tobytes()
                sets = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(sets, pa.binary())], schema=schema
                )
            give_back()

    return texts.mapInArrow(run, "id long, shingles binary")


def _least_estimate(percent: int) -> int:
    """Equal coordinates of sketches that a pair of the wanted similarity has all but surely."""
    p = percent / 100
    return int(COORDINATES * p - DEVIATIONS * (COORDINATES * p * (1 - p)) ** 0.5)


def _pair_up(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """Add the ``value`` of both partners of each pair; a partner of very many is salted."""
    for who in ("b", "a"):
        other = side.select(F.col("id").alias(who), F.col(value).alias(f"{value}_{who}"))
        pairs = salted_join(pairs, other, who, "a" if who == "b" else "b", frequent_keys(pairs, who))
    return pairs


def _kept_pairs(pairs: DataFrame, value: str, keep) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Views of the batch, not copies: sets are as long as their texts.
            pairs = zip(batch.column(2), batch.column(3), strict=True)
            kept = pa.array([keep(x.as_buffer(), y.as_buffer()) for x, y in pairs], pa.bool_())
            yield batch.select([0, 1]).filter(kept)
            give_back()

    return pairs.select("a", "b", f"{value}_a", f"{value}_b").mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sketches do not rule them out."""
    least = _least_estimate(percent)

    def alike(x: bytes, y: bytes) -> bool:
        return int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) >= least

    return _kept_pairs(_pair_up(pairs, signed, "sketch"), "sketch", alike)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    def similar(x: bytes, y: bytes) -> bool:
        return _common(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)

    return _kept_pairs(_pair_up(pairs, sets, "shingles"), "shingles", similar)


def _verified(pairs: DataFrame, signed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links among candidate pairs: sketches first, then full sets of the texts still in play."""
    likely = written(_likely(pairs, signed, percent), "likely")
    wanted = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
    sets = written(_sets(texts.join(wanted, "id", "left_semi")), "sets")
    return written(_linked(likely, sets, percent), "links")


def _common(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _piecewise(members: DataFrame, group: str, work) -> DataFrame:
    """``(a, b)`` that ``work`` finds in each group; large groups are cut, every two pieces meet."""
    sized = members.join(members.groupBy(group).agg(F.count("*").alias("size")), group)
    pieces = F.ceil(F.col("size") / PIECE).cast("int")
    own = F.pmod(F.xxhash64("id"), pieces).cast("int")
    placed = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    placed = placed.withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))

    def run(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        left = np.flatnonzero(own == table.column("p")[0].as_py())
        right = np.flatnonzero(own == table.column("q")[0].as_py())
        ids = table.column("id").to_numpy()
        found = [(int(ids[i]), int(ids[j])) for i, j in work(table, left, right)]
        columns = [[x for x, _ in found], [y for _, y in found]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    # Rows of a group come together by the join on it, and its pieces would stay where they are.
    dealt = placed.repartition(group, "p", "q")
    return dealt.groupBy(group, "p", "q").applyInArrow(run, "a long, b long")


def _partners(table: pa.Table, left: np.ndarray, right: np.ndarray, least: int):
    """For each member on the left: those on the right of other components that may be linked with it."""
    sketches = np.array([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("sketch")])
    now = table.column("now").to_numpy()
    for i in left.tolist():
        alike = (sketches[right] == sketches[i]).sum(1)
        partner = np.flatnonzero((alike >= least) & (now[right] != now[i]))
        yield i, right[partner[np.argsort(-alike[partner], kind="stable")]]


def _likely_within(members: DataFrame, percent: int) -> DataFrame:
    """Edges that connect all members of a bucket whose estimates allow a link across components.

    ``members`` has ``(bucket, id, now, sketch)``. As many edges come out as join them, not all pairs.
    """
    least = _least_estimate(percent)

    def work(table: pa.Table, left: np.ndarray, right: np.ndarray):
        label = np.arange(len(table))
        for i, partners in _partners(table, left, right, least):
            for other in np.unique(label[partners]).tolist():
                if other != label[i]:
                    yield i, other
                    label[label == other] = label[i]

    return _piecewise(members, "bucket", work)


def _links_within(members: DataFrame, percent: int) -> DataFrame:
    """Links across components among the members of each cluster, as many as join components.

    ``members`` has ``(cluster, id, now, sketch, shingles)``, ``now`` being the component so far. A pair
    is tested on its full sets if its estimate allows a link and nothing found so far joins it. So a
    group costs tests, but never more links than members.
    """
    least = _least_estimate(percent)

    def work(table: pa.Table, left: np.ndarray, right: np.ndarray):
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        now = table.column("now").to_pylist()
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        for i, partners in _partners(table, left, right, least):
            for j in partners.tolist():
                mine, other = root(now[i]), root(now[j])
                if mine != other and _common(sets[i], sets[j], percent):
                    joined[mine] = other
                    yield i, j

    return _piecewise(members, "cluster", work)


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Words are runs of bytes other than blank and U+0009 to U+000D, with A-Z lowered. Two texts are
    linked if ``100 * |intersection| >= percent * |union|`` of their sets of 5-word shingles. The
    component is the smallest id reachable over links; the row of that id is kept. A null text or one
    without words has no shingle, is linked with nothing and is kept. Rows with one id are one node
    that has the links of all of them; rows without an id are alone and kept. Other columns are not
    read.

    Bands are as long as ``percent`` allows (``band_rows``); one so low that hardly any coordinate is
    shared is an error.

    Equal sets are one class from the start, by a digest that is grouped with partial aggregation.
    Texts that share a band are candidates. Within a bucket the least id is tested against all
    others: linear, and enough where copies are alike. In buckets that still hold several components
    estimates tell which texts may be linked across them; these form clusters, and the texts of a
    cluster meet piece by piece, where what could join two components is tested on full sets. So pairs
    of a group are tested where they must be, and never become rows.
    """
    texts = _texts(docs, id, text)
    signed = written(sign(docs, id, text, percent), "signatures")
    real = signed.where(F.col("id").isNotNull() & (F.col("n") > 0))
    key = ["n", "d1", "d2"]
    classes = written(
        real.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes"
    )
    hot = frequent_keys(classes, key, weight="copies")
    members = written(
        salted_join(real.select("id", *key), classes.select(*key, "rep"), key, "id", hot).select("id", "rep"),
        "members",
    )
    # One row of each class stands for it; rows of one id and digest are the same.
    reps = real.join(classes.select(F.col("rep").alias("id"), *key), ["id", *key], "left_semi")
    reps = written(reps.dropDuplicates(["id", *key]), "representatives")

    banded = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
    crowded = written(
        banded.groupBy("bucket")
        .agg(
            F.min("band").alias("band"),
            F.min("id").alias("pivot"),
            F.count("*").alias("size"),
            F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("all"),
        )
        .where("size > 1"),
        "buckets",
    )
    often = frequent_keys(crowded, "bucket", weight="size")
    stars = salted_join(
        banded, crowded.select("bucket", "pivot"), "bucket", "id", often
    ).where("id <> pivot")
    tested = written(stars.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    links = _verified(tested, signed, texts, percent)

    # Rows with one id in several classes link these.
    several = members.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    same = members.join(several.select("id", "a"), "id").select("a", F.col("rep").alias("b")).where("a <> b")
    links = links.union(same)
    component = written(connected_components(links), "components")

    # Buckets of more than two that hold several components; of equal buckets the first.
    wide = crowded.where("size > 2").groupBy("pivot", "size", "all").agg(
        F.min_by("bucket", "band").alias("bucket")
    )
    inside = _with_component(banded.join(wide.select("bucket"), "bucket"), component, "now")
    mixed = (
        inside.groupBy("bucket")
        .agg(F.min("now").alias("least"), F.max("now").alias("most"))
        .where("least <> most")
        .select("bucket")
    )
    sketches = reps.select("id", "sketch")
    inside = written(inside.select("bucket", "id", "now").join(mixed, "bucket").join(sketches, "id"), "mixed")
    likely = written(_likely_within(inside, percent), "likely_within")
    # What may be linked is one cluster, whichever buckets it shares: full sets travel once a piece.
    clusters = connected_components(likely).select(
        F.col("node").alias("id"), F.col("component").alias("cluster")
    )
    clusters = written(_with_component(clusters, component, "now"), "clusters")
    sets = _sets(texts.join(clusters.select("id"), "id", "left_semi")).where(F.octet_length("shingles") > 0)
    known = clusters.join(sketches, "id").join(written(sets, "cluster_sets"), "id")
    more = written(_links_within(known, percent), "more_links")
    if more.take(1):
        component = written(connected_components(links.union(more)), "components")
    result = signed.select("id", F.col("n").alias("n_shingles"), *key)
    copied = frequent_keys(classes, "rep", weight="copies")
    named = _with_component(members, component, "component", "rep", copied)
    named = named.groupBy("id").agg(F.min("component").alias("component"))
    result = result.join(named, "id", "left").select(
        F.col("id").alias(id),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("component"), F.col("id")).eqNullSafe(F.col("id")).alias("kept"),
    )
    return result


def _with_component(
    rows: DataFrame, component: DataFrame, name: str, node: str = "id", hot: Sequence[int] = ()
) -> DataFrame:
    """Add the component of a node, which is itself where nothing links it."""
    found = component.select(F.col("node").alias(node), F.col("component").alias("__component"))
    joined = salted_join(rows, found, node, "id", hot, "left")
    return joined.withColumn(name, F.coalesce("__component", node)).drop("__component")
