"""SimHash near-duplicates through pivot distance tables."""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stocktake.llm.common import append_columns, free_name, stored
from stocktake.llm.components import components
from stocktake.llm.words import mix

PIVOTS = 16
#: Shingles voted on at a time.
VOTES = 1 << 16


def pivots(n: int = PIVOTS, seed: int = 64) -> np.ndarray:
    """The reference fingerprints: fixed random 64-bit words."""
    return np.random.default_rng(seed).integers(0, 1 << 64, size=n, dtype=np.uint64)


def fingerprint(text: str, words: int, hash64) -> int:
    """Majority of the shingles' hash bits (signed); no words: zero."""
    norm = text.encode("utf-8", "replace").lower().split()
    if not norm:
        return 0
    joined = b" ".join(norm)
    if len(norm) <= words:
        hashes = [hash64(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, norm), np.int64, len(norm)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        hashes = [hash64(joined[s:e], 42) for s, e in zip(starts[:len(norm) - words + 1].tolist(), (ends[words - 1:] - 1).tolist(), strict=True)]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), VOTES):
        bits = np.unpackbits(np.array(hashes[at:at + VOTES], dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big", signed=True)


def with_fingerprints(docs: DataFrame, text_col: str = "text", words: int = 4, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``) with the signed 64-bit ``fp`` of each whole text; null text: empty."""
    def make():
        import xxhash
        hash64 = xxhash.xxh64_intdigest
        return lambda texts: [pa.array([fingerprint(t.as_py(), words, hash64) for t in texts], pa.int64())]
    return append_columns(docs, text_col, [StructField("fp", LongType())], make, keep)


@lru_cache(maxsize=4)
def band_tables(bands: int) -> list[tuple[int, int, np.ndarray]]:
    """For each band of bits (shift, mask, code of each value): values get one code exactly if all
    their distances to the reference fingerprints, restricted to the band, are the same."""
    out, shift = [], 0
    for b in range(bands):
        width = 64 // bands + (b < 64 % bands)
        values = np.arange(1 << width, dtype=np.uint64)
        refs = (pivots() >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        distances = np.bitwise_count(values[:, None] ^ refs[None, :])
        out.append((shift, (1 << width) - 1, np.unique(distances, axis=0, return_inverse=True)[1].reshape(-1).astype(np.uint64)))
        shift += width
    return out


PACKED = [f"far{i}" for i in range(PIVOTS // 8)]


def _distance(packed: str, lane: int, side: str) -> Column:
    return F.shiftright(F.col(f"{side}.{packed}"), 8 * lane).bitwiseAND(F.lit(255))


def links(prints: DataFrame, max_bits: int = 4, spare_bands: int = 3) -> DataFrame:
    """Distinct fingerprints (fp) -> every pair (u, v), u < v, at ``max_bits`` or fewer differing bits.

    Each fingerprint gets a row of the pivot distance table: its Hamming distances to the reference
    fingerprints, over the whole word and over each of ``max_bits + spare_bands`` bands. Few
    differing bits leave at least ``spare_bands`` bands untouched, whose coordinates are then equal;
    so fingerprints meet under every combination of that many bands' coordinates, which finds all
    pairs. Pairs whose whole-word coordinates differ by more than ``max_bits`` anywhere are
    discarded (a distance to a pivot changes by one a bit at most), and the survivors are verified.

    Only distinct fingerprints enter, keys held by one of them leave before the join, and AQE splits
    what a dense neighbourhood still puts under one key.
    """
    bands = max_bits + spare_bands
    schema = StructType([StructField(n, LongType()) for n in ("key", "fp", *PACKED)])

    def table(batches):
        refs, tables = pivots(), band_tables(bands)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            codes = [codes[((fp >> np.uint64(shift)) & np.uint64(mask)).astype(np.int64)] for shift, mask, codes in tables]
            far = []
            for at in range(0, PIVOTS, 8):
                lanes = np.bitwise_count(fp[:, None] ^ refs[None, at:at + 8]).astype(np.uint64)
                far.append(np.bitwise_or.reduce(lanes << (np.arange(8, dtype=np.uint64) * np.uint64(8))[None, :], axis=1).view(np.int64))
            for j, combo in enumerate(itertools.combinations(range(bands), spare_bands)):
                key = np.full(len(fp), j + 1, dtype=np.uint64)
                for b in combo:
                    key = key * np.uint64(1 << (64 // bands + 1)) + codes[b]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mix(key).view(np.int64), fp.view(np.int64), *far)], schema.names)

    keyed = prints.select("fp").mapInArrow(table, schema)
    keyed = keyed.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("met > 1").drop("met")
    keyed = stored(keyed, "pivot-keys")
    near = [F.abs(_distance(p, lane, "a") - _distance(p, lane, "b")) <= max_bits for p in PACKED for lane in range(8)]
    on = F.expr("a.key = b.key and a.fp < b.fp")
    for c in near:
        on = on & c
    pairs = keyed.alias("a").join(keyed.alias("b"), on & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits))
    return pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def groups(prints: DataFrame, id_col: str = "doc_id", max_bits: int = 4) -> DataFrame:
    """Stored rows (id_col, fp) -> one row a distinct fingerprint: fp, component_id, n_linked.

    component_id: the smallest id reachable over links (null only if all of them are null);
    n_linked: other distinct fingerprints linked directly.
    """
    distinct = stored(prints.groupBy("fp").agg(F.min(id_col).alias("low")), "fingerprints")
    pairs = stored(links(distinct, max_bits), "fingerprint-links")
    # a component is known by its smallest fingerprint first, then by its smallest id
    member = components(pairs).select(F.col("node").alias("fp"), "component")
    degree = pairs.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    joined = distinct.join(member, "fp", "left").join(degree, "fp", "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("component"), F.coalesce("n", F.lit(0)).alias("n_linked"))
    low = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    return joined.join(low, "component").select("fp", "component_id", "n_linked")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id, n_linked.

    Null and empty texts have fingerprint zero and are linked like any other. Rows with a null id
    get their group's component_id. Repeated rows stay repeated; an empty table gives no rows.
    """
    prints = stored(with_fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
                                      "text", words, ["doc_id"]), "document-prints")
    return prints.join(groups(prints, "doc_id", max_bits), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_linked")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id (nulls last), whole rows.

    Rows are told apart by their place in a scan, which is stored beside them: a second scan may be
    split otherwise, as executors come and go. Of rows that share the smallest id one stays. Only the
    places of the rows that go are joined back.
    """
    place, key = free_name(docs, "place__"), "id__"
    placed = stored(docs.withColumn(place, F.monotonically_increasing_id()), "placed-documents")
    narrow = placed.select(F.col(place).alias("place__"), F.col(id_col).cast("long").alias(key), F.col(text_col).cast("string").alias("text"))
    prints = stored(with_fingerprints(narrow, "text", words, ["place__", key]), "document-prints")
    # the row that stays: the smallest of each fingerprint, then of each group; both sums are combined on the map side
    row = F.struct(F.col(key).isNull().alias("null_id"), F.col(key).alias("id"), F.col("place__").alias("place"))
    lowest = prints.groupBy("fp").agg(F.min(row).alias("row"))
    member = groups(prints, "place__", max_bits).select("fp", "component_id")
    stays = lowest.join(member, "fp").groupBy("component_id").agg(F.min("row").alias("row")).select(F.col("row.place").alias("place__"))
    gone = prints.select("place__").join(stays.hint("shuffle_hash"), "place__", "left_anti").select(F.col("place__").alias(place))
    # the rows that go grow with the input, so they are never broadcast; the hash join leaves the texts unsorted, and no
    # step joins documents on their fingerprint or group, which a third of them may share
    return placed.join(gone.hint("shuffle_hash"), place, "left_anti").select(*docs.columns)
