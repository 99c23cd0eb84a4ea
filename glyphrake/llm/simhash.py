"""SimHash near-duplicates found by pigeonring filtering.

A fingerprint is a ring of segments (bytes).  If two fingerprints differ in t bits or
fewer, some chain of consecutive segments exists whose first l segments differ in no
more than l / m of t, for every length l up to all m segments.  While l t / m is below
1 the chain must agree exactly, which gives the key on which fingerprints are joined;
the further budgets prune candidates before the full Hamming distance is taken.

Wide thresholds have no exact part worth joining on.  There the keys are samples of
bits, in as many tables as the wanted recall takes, and the chain budgets prune as
before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphrake.llm.common import gathered, materialize, table, unused
from glyphrake.llm.components import connected_components

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 2
#: Fingerprints with the same key from which a finer key is used, and up to which all pairs are compared.
CROWDED, COMPARED = 2_000, 48
#: Of sampled keys: the fingerprints that one is meant to have (as a power of two), those that meet in one matrix, and rows that a key may have before it is divided.
KEY_BITS, MATRIX, RUN_ROWS = 8, 1_024, 2_000_000
#: Members of a crowd whose sets of shingles meet in one task, and those nearest to its middle that meet all of them.
CROWD, HUBS = 400, 32


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of the text's words, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist())), np.uint64, len(last))


def simhash(text: str | None, shingle: int = SHINGLE, bits: int = BITS) -> bytes:
    """The fingerprint, highest bit first; a bit is 1 if set in over half the hashes.

    A text without words has fingerprint zero, one with fewer words than a shingle has
    the whole sequence as its only shingle.  Wider fingerprints take their further
    64-bit words from remixed hashes.
    """
    hashes = _shingle_hashes(text, shingle)
    out = []
    for word in range(bits // 64):
        h = hashes
        if word:
            h = (h ^ np.uint64(0x9E3779B97F4A7C15 * word % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 65_536):
            part = h[at : at + 65_536]
            counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(counts * 2 > len(h)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint BINARY) of every document, in one pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(x.as_py(), shingle, bits) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint binary")


def exact_run(segments: int, distance: int) -> int:
    """Segments at the head of a chain that must agree exactly."""
    return min(segments, -(-segments // distance) - 1) if distance else segments


def _ring_keys(node: DataFrame, bits: int, distance: int) -> DataFrame:
    """A row for every start of a chain: the start and the bytes that must agree."""
    size, run = bits // 8, exact_run(bits // 8, distance)
    ring = F.concat("fingerprint", "fingerprint")
    starts = F.array(*(F.struct(F.lit(i).alias("start"), ring.substr(F.lit(i + 1), F.lit(run)).alias("bytes")) for i in range(size)))
    return node.select("node", "fingerprint", F.explode(starts).alias("chain")).select("node", "fingerprint", F.col("chain.start").alias("start"), F.xxhash64("chain.start", "chain.bytes").alias("key"))


def _finer_keys(rows: DataFrame, bits: int, distance: int) -> DataFrame:
    """Keys for chains that too many fingerprints share: of the other segments, all but distance agree as well.

    With all but distance segments fixed, no key can have more than 2 to the power of
    8 x distance fingerprints, whatever the number of documents.
    """
    size, run = bits // 8, exact_run(bits // 8, distance)
    ring = F.concat("fingerprint", "fingerprint")
    rest = range(run, size)
    choices = [c for c in combinations(rest, len(rest) - distance)] if len(rest) > distance else [()]
    finer = F.array(*(F.xxhash64(F.lit(k), "key", *(ring.substr(F.col("start") + j + 1, F.lit(1)) for j in c)) for k, c in enumerate(choices)))
    return rows.select("node", "fingerprint", "start", F.explode(finer).alias("key"))


def _sampled_keys(node: DataFrame, bits: int, distance: int, recall: float, rows: int) -> DataFrame:
    """Keys of sampled bits, in so many tables that a pair at the distance meets in one of them with probability recall.

    A key has KEY_BITS bits fewer than it takes to number the fingerprints: some hundred
    strangers share it at any size, which is cheap to compare, and the fewer bits of a
    key, the fewer tables it takes.
    """
    width = min(48, max(10, math.ceil(math.log2(max(rows, 2))) - KEY_BITS))
    meet = (1 - distance / bits) ** width
    tables = math.ceil(math.log(1 - recall) / math.log(1 - meet))
    drawn = np.random.default_rng(20_240_229)
    places = [drawn.choice(bits, width, replace=False) for _ in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4_096):
                part = batch.slice(begin, 4_096)
                on = np.unpackbits(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, bits // 8), axis=1)
                for i, at in enumerate(places):
                    key = on[:, at].astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.zeros(part.num_rows, np.int32)), pa.array(key * tables + i)], names=["node", "fingerprint", "start", "key"])

    return node.select("node", "fingerprint").mapInArrow(run, "node long, fingerprint binary, start int, key long")


def _differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each segment (byte)."""
    return np.bitwise_count(a ^ b)


def within(a: np.ndarray, b: np.ndarray, distance: int, start: np.ndarray | None = None) -> np.ndarray:
    """Whether rows of segments are within the distance; with start, only pairs whose chain from there keeps its budgets.

    Pairs are dropped at the first chain length that is over budget, so most never see
    the full comparison.
    """
    size = a.shape[1]
    if start is None:
        # some chain of two must keep its budgets; then all segments count
        diff = _differences(a, b)
        one = diff <= distance / size
        two = diff + np.roll(diff, -1, axis=1) <= 2 * distance / size
        return (one & two).any(axis=1) & (diff.sum(axis=1, dtype=np.int64) <= distance)
    alive, total = np.arange(len(a)), np.zeros(len(a), np.int64)
    for length in range(1, size + 1):
        at = (start[alive] + length - 1) % size
        total = total + np.bitwise_count(a[alive, at] ^ b[alive, at])
        fits = total <= length * distance // size
        alive, total = alive[fits], total[fits]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _close(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Whether fingerprints of 64-bit words are within the distance; the words are the ring's segments."""
    diff = np.bitwise_count(a ^ b).astype(np.int16)
    size, total = diff.shape[-1], diff.sum(axis=-1)
    # some chain of two must keep its budgets
    return ((diff * size <= distance) & ((diff + np.roll(diff, -1, axis=-1)) * size <= 2 * distance)).any(axis=-1) & (total <= distance)


def _spread(words: np.ndarray, distance: int) -> list[np.ndarray]:
    """Groups of more than one fingerprint that links within the distance connect."""
    n, groups = len(words), []
    close = _close(words[:, None], words[None], distance) if n <= MATRIX else None
    waiting = np.ones(n, bool)
    if close is not None:
        np.fill_diagonal(close, False)
        waiting = close.any(axis=1)
    for seed in range(n):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        group, reached = [seed], [seed]
        while reached:
            if close is not None:
                new = np.flatnonzero(close[reached].any(axis=0) & waiting)
                reached = []
            else:
                left = np.flatnonzero(waiting)
                new = left[_close(words[left], words[reached.pop()], distance)]
            waiting[new] = False
            group += new.tolist()
            reached += new.tolist()
        if len(group) > 1:
            groups.append(np.array(group))
    return groups


def _chunks(node: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """The nodes of a crowd in chunks of CROWD, each with the HUBS that are nearest to the crowd's middle.

    What many members are like is in the middle, so hubs connect chunks (_across finds what
    they leave apart).  Smaller crowds are whole.
    """
    if len(node) <= CROWD + HUBS:
        return [np.sort(node)]
    bits = np.zeros(words.shape[1] * 64, np.int64)
    for at in range(0, len(words), 65_536):
        bits += np.unpackbits(words[at : at + 65_536].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    middle = np.packbits(2 * bits > len(words)).view(np.uint64)
    away = np.bitwise_count(words ^ middle).sum(axis=1)
    order = np.lexsort((node, away))
    hubs, rest = order[:HUBS], order[HUBS:]
    rest = rest[np.lexsort(words[rest].T)]
    return [np.sort(node[np.concatenate((hubs, rest[at : at + CROWD]))]) for at in range(0, len(rest), CROWD)]


def _name(members: np.ndarray) -> int:
    """A number for a set of nodes, handed in sorted."""
    return xxhash.xxh64_intdigest(members.tobytes()) >> 1


def _sampled_links(node: np.ndarray, words: np.ndarray, key: np.ndarray, distance: int, crowds: list[list[np.ndarray]] | None) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; of groups larger than COMPARED one link each, or with a list of crowds the chunks of each."""
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    lengths = np.diff(edges)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    short = np.repeat(lengths <= COMPARED, lengths)
    for offset in range(1, min(COMPARED, int(lengths[lengths <= COMPARED].max(initial=0)))):
        i = np.flatnonzero((key[offset:] == key[:-offset]) & short[:-offset])
        if not len(i):
            break
        i = i[_close(words[i], words[i + offset], distance)]
        left.append(node[i])
        right.append(node[i + offset])
    for first, length in zip(edges[:-1][lengths > COMPARED].tolist(), lengths[lengths > COMPARED].tolist()):
        own_words, own_node = words[first : first + length], node[first : first + length]
        for members in _spread(own_words, distance):
            if len(members) <= COMPARED:
                i, j = (members[x] for x in np.triu_indices(len(members), 1))
                hit = _close(own_words[i], own_words[j], distance)
                i, j = i[hit], j[hit]
            elif crowds is None:
                i, j = members[1:], np.broadcast_to(members[:1], len(members) - 1)
            else:
                crowds.append(_chunks(own_node[members], own_words[members]))
                continue
            left.append(own_node[i])
            right.append(own_node[j])
    return np.concatenate(left), np.concatenate(right)


def _links(node: np.ndarray, ring: np.ndarray, start: np.ndarray, key: np.ndarray, distance: int, chained: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys that connect just what all links would.

    Short runs are compared at each offset at once.  In long runs a search spreads from
    fingerprint to fingerprint over those not reached yet, so that a crowd of near
    copies costs one pass and yields one link each.
    """
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    lengths = np.diff(edges)
    left, right = [], []
    short = np.repeat(lengths <= COMPARED, lengths)
    for offset in range(1, min(COMPARED, int(lengths.max(initial=0)))):
        i = np.flatnonzero((key[offset:] == key[:-offset]) & short[:-offset])
        if not len(i):
            break
        i = i[within(ring[i], ring[i + offset], distance, start[i] if chained else None)]
        left.append(node[i])
        right.append(node[i + offset])
    for first, length in zip(edges[:-1][lengths > COMPARED].tolist(), lengths[lengths > COMPARED].tolist()):
        own_ring, own_node, own_start = ring[first : first + length], node[first : first + length], start[first : first + length]
        waiting = np.arange(length)
        while len(waiting):
            reached, waiting = [int(waiting[0])], waiting[1:]
            while reached and len(waiting):
                at = reached.pop()
                hit = within(own_ring[waiting], np.broadcast_to(own_ring[at], (len(waiting), ring.shape[1])), distance, own_start[waiting] if chained else None)
                new = waiting[hit]
                left.append(np.full(len(new), own_node[at]))
                right.append(own_node[new])
                reached.extend(new.tolist())
                waiting = waiting[~hit]
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _link_runs(rows: DataFrame, bits: int, distance: int, chained: bool, crowds: bool = False) -> DataFrame:
    """Links (a, b) between nodes with a common key; a key's rows meet in one task, one after the other.

    Keys are few enough to be held as a whole: chained ones by what they leave open, sampled
    ones by _in_parts().
    With crowds there are columns crowd and split: null for links; the rows (node, node,
    crowd, split) say who is in a crowd or in a chunk of one, and split which crowd a chunk
    is of.  Both go by their members and so are the same whatever the key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            node, start, key = (whole.column(c).to_numpy() for c in ("node", "start", "key"))
            ring = np.frombuffer(b"".join(whole.column("fingerprint").to_pylist()), np.uint8).reshape(len(node), bits // 8)
            found: list[list[np.ndarray]] | None = [] if crowds else None
            a, b = _links(node, ring, start, key, distance, True) if chained else _sampled_links(node, ring.view(np.uint64), key, distance, found)
            if found is None:
                return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            members, crowd, split = [np.zeros(0, np.int64)], [None] * len(a), [None] * len(a)
            for chunks in found:
                own = _name(np.unique(np.concatenate(chunks))) if len(chunks) > 1 else None
                for chunk in chunks:
                    members.append(chunk)
                    crowd += [_name(chunk)] * len(chunk)
                    split += [own] * len(chunk)
            member = np.concatenate(members)
            columns = [np.concatenate((a, member)), np.concatenate((b, member)), crowd, split]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["a", "b", "crowd", "split"])

        for batch in gathered(batches):
            key = batch.column(3).to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1])
            cut = int(change[-1]) + 1 if len(change) else 0
            if held and (cut or held[-1].column(3)[-1].as_py() != key[0]):
                yield links([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield links([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield links(held)

    dealt = rows.select("node", "fingerprint", "start", "key").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long" + ", crowd long, split long" * crowds)


def _in_parts(rows: DataFrame, n: int) -> DataFrame:
    """rows of n fingerprints in which a sampled key of more than RUN_ROWS is a key for each two parts of it.

    Parts go by hash and have RUN_ROWS / 2 rows on average; any two rows of the key meet
    under one of its new keys, so no link is lost.  Rows grow by the number of parts, for
    such keys alone.
    """
    if n <= RUN_ROWS:  # no key can have more
        return rows
    rows = materialize(rows, "simhash-keys")
    counts = rows.groupBy("key").count().where(F.col("count") > RUN_ROWS)
    large = materialize(counts.select("key", F.ceil(F.col("count") * 2 / RUN_ROWS).cast("long").alias("parts")), "simhash-large-keys")
    if large.isEmpty():
        return rows
    part = F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("parts"))
    divided = rows.join(large, "key").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("part <> other")
    divided = divided.withColumn("key", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))).select(rows.columns)
    return rows.join(large, "key", "left_anti").select(rows.columns).unionByName(divided)


def link_fingerprints(nodes: DataFrame, bits: int = BITS, distance: int = DISTANCE, recall: float | None = None, crowds: bool = False) -> DataFrame:
    """Links (a, b) between distinct fingerprints (node BIGINT, fingerprint BINARY), enough to connect all that are close.

    Without recall the search is exact.  With recall and crowds, which _link_runs
    describes, the links that a crowd needs are still to be found.
    """
    if recall is not None:
        n = nodes.count()
        return _link_runs(_in_parts(_sampled_keys(nodes, bits, distance, recall, n), n), bits, distance, False, crowds)
    if crowds:
        raise ValueError("crowds come from sampled keys: pass a recall")
    if distance == 0:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    if exact_run(bits // 8, distance) < 1:
        raise ValueError("the distance leaves no segment that must agree: pass a recall")
    keys = _ring_keys(nodes, bits, distance)
    counts = keys.groupBy("key").count()
    crowded = materialize(counts.where(F.col("count") > CROWDED).select("key"), "simhash-crowded")
    calm = _link_runs(keys.join(crowded, "key", "left_anti"), bits, distance, True)
    if crowded.isEmpty():
        return calm
    return calm.unionByName(_link_runs(_finer_keys(keys.join(crowded, "key", "left_semi"), bits, distance), bits, distance, True))


def _crowd_links(crowd: pa.Table, similarity: float) -> pa.Table:
    """Links (a, b) that connect what all similar pairs of a crowd (node, shingles) would.

    A search spreads from set to set over those not reached yet; a set leaves them only
    when its similarity to the one at hand is confirmed.
    """
    node, shingles = crowd.column("node").to_numpy(), crowd.column("shingles").combine_chunks()
    sizes = pc.list_value_length(shingles).to_numpy(zero_copy_only=False).astype(np.int64)
    _, value, times = np.unique(shingles.flatten().to_numpy(), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(len(node)), sizes)[np.argsort(value, kind="stable")]
    begin, first = np.cumsum(times) - times, np.cumsum(sizes) - sizes
    left, right, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.ones(len(node), bool)
    for seed in range(len(node)):
        if not waiting[seed]:
            continue
        reached, waiting[seed] = [seed], False
        while reached and waiting.any():
            at = reached.pop()
            own = value[first[at] : first[at] + sizes[at]]
            n = times[own]
            held = holders[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            common = np.bincount(held, minlength=len(node))
            new = np.flatnonzero(waiting & (common >= similarity * (sizes + sizes[at] - common)))
            left.append(np.full(len(new), node[at]))
            right.append(node[new])
            reached.extend(new.tolist())
            waiting[new] = False
    return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})


def _meet(block: pa.Table, similarity: float) -> pa.Table:
    """Links (a, b) from the rows that ask to similar rows that don't and have another root: one to each root."""
    asks = block.column("asks").combine_chunks()
    asking, asked = block.filter(asks), block.filter(pc.invert(asks))
    node, root, shingles = asked.column("node").to_numpy(), asked.column("root").to_numpy(), asked.column("shingles").combine_chunks()
    sizes = pc.list_value_length(shingles).to_numpy(zero_copy_only=False).astype(np.int64)
    values, value, times = np.unique(shingles.flatten().to_numpy(), return_inverse=True, return_counts=True)
    holders, begin = np.repeat(np.arange(len(node)), sizes)[np.argsort(value, kind="stable")], np.cumsum(times) - times
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for one, own_root, own in zip(asking.column("node").to_pylist(), asking.column("root").to_pylist(), asking.column("shingles")):
        own = own.values.to_numpy()
        at = np.flatnonzero(np.isin(values, own, assume_unique=True))
        n = times[at]
        held = holders[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        common = np.bincount(held, minlength=len(node))
        hit = np.flatnonzero((root != own_root) & (common >= similarity * (sizes + len(own) - common)))
        _, first = np.unique(root[hit], return_index=True)
        left.append(np.full(len(first), one))
        right.append(node[hit[first]])
    return pa.table({"a": np.concatenate(left), "b": np.concatenate(right)})


def _across(similar: DataFrame, split: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of crowds (node, split) that no chunk of the crowd has together.

    similar are the links so far.  Members that they connect to most of the crowd need no
    more; the others, few where the hubs are the originals, meet all members in blocks of
    about CROWD by CROWD sets.  Crowds of one and the same main group count as one, so
    that what several keys found is compared once.
    """
    roots = connected_components(similar, "simhash-within")
    placed = materialize(split.join(roots, "node", "left").select("node", "split", F.coalesce("root", "node").alias("root")), "simhash-placed")
    main = placed.groupBy("split", "root").count().groupBy("split").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    members = materialize(placed.join(main, "split").select("main", "node", "root").distinct(), "simhash-members")
    apart = F.col("root") != F.col("main")
    tally = materialize(members.groupBy("main").agg(F.ceil(F.count("*") / CROWD).alias("blocks"), F.ceil(F.count_if(apart) / CROWD).alias("strips")).where("strips > 0"), "simhash-tally")
    if tally.isEmpty():
        return similar.limit(0)
    dealt = members.join(tally, "main").join(sets, "node")
    place, zero = F.xxhash64("node"), F.lit(0).cast("long")
    asked = dealt.select("main", F.pmod(place, "blocks").alias("block"), F.explode(F.sequence(zero, F.col("strips") - 1)).alias("strip"), F.lit(False).alias("asks"), "node", "root", "shingles")
    asking = dealt.where(apart).select("main", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), F.pmod(place, "strips").alias("strip"), F.lit(True).alias("asks"), "node", "root", "shingles")
    return asked.unionByName(asking).groupBy("main", "block", "strip").applyInArrow(lambda block: _meet(block, similarity), "a long, b long")


def _similar(links: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, bits: int, similarity: float) -> DataFrame:
    """The links whose documents' sets of shingles are similar (intersection over union), and links within crowds.

    The first document of a fingerprint stands for it.  Only documents with links have
    their shingles read; each link meets the two sets by equal joins.  The sets of a
    chunk of a crowd (see _chunks) meet in one task; _across finds the links between chunks.
    """
    found = materialize(links.where("a <> b or crowd is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "crowd", "split").distinct(), "simhash-candidates")
    links, crowds = found.where("crowd is null").select("a", "b"), found.where("crowd is not null").select(F.col("a").alias("node"), "crowd").distinct()
    linked = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.join(linked, "node").select("node", "fingerprint", "first_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(node, np.unique(_shingle_hashes(text, shingle)).view(np.int64)) for node, fingerprint, text in zip(*(c.to_pylist() for c in batch.columns)) if simhash(text, shingle, bits) == fingerprint]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), "text").join(wanted, "first_id").select("node", "fingerprint", "text")
    sets = materialize(texts.mapInArrow(read, "node long, shingles array<long>").dropDuplicates(["node"]), "simhash-shingles")
    both = links.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    similar = both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")
    similar = similar.unionByName(crowds.join(sets, "node").groupBy("crowd").applyInArrow(lambda crowd: _crowd_links(crowd, similarity), "a long, b long"))
    split = found.where("split is not null").select(F.col("a").alias("node"), "split").distinct()
    if split.isEmpty():
        return similar
    similar = materialize(similar, "simhash-similar")
    return similar.unionByName(_across(similar, split, sets, similarity))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, distance: int = DISTANCE, recall: float | None = None, similarity: float | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id of every document.

    component_id is the smallest doc_id that links lead to, the document's own included.
    Texts that are null or have no words have fingerprint zero and link like others.
    Rows with a null id take part and get the component of their fingerprint (null if
    only such rows are in it).  Repeated rows stay.  Only distinct fingerprints are
    compared, so exact copies cost one row each.  With similarity, links between
    different fingerprints also need that similarity of their sets of shingles.
    """
    found = materialize(fingerprints(docs, shingle, bits), "simhash-fingerprints")
    as_node = F.conv(F.hex("fingerprint"), 16, -10).cast("long") if bits == 64 else F.xxhash64("fingerprint")
    found = found.withColumn("node", as_node)
    nodes = materialize(found.groupBy("node", "fingerprint").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    links = link_fingerprints(nodes.select("node", "fingerprint"), bits, distance, recall, similarity is not None)
    if similarity is not None:
        links = _similar(links, nodes, docs, shingle, bits, similarity)
    roots = connected_components(links, "simhash-links")
    linked = nodes.join(roots, "node").select("node", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(least, "root").select("node", "component_id")
    # a table of its own, so that Spark can split a fingerprint that very many documents have
    labels = materialize(nodes.select("node", "first_id").join(linked, "node", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id")), "simhash-labels")
    return found.join(labels, "node").select("doc_id", "fingerprint", "component_id")


def first_of_each(docs: DataFrame, shingle: int = 5, bits: int = 256, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """docs with one document of each group of near copies: the one with the smallest id.

    similarity is that of sets of shingles (intersection over union).  The angle that
    goes with it gives the share of bits that may differ; two standard deviations are added,
    and what links then is checked on the sets.  Of rows that repeat an id one stays, the
    first by hash of its text and then of all its columns; rows with a null id all stay.
    """
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    distance = int(bits * angle + 2 * math.sqrt(bits * angle * (1 - angle)))
    found = near_duplicates(docs, shingle, bits, distance, recall, similarity)
    keep = materialize(found.where("doc_id = component_id").groupBy("doc_id").agg((F.count("*") > 1).alias("again")), "simhash-kept")
    once = docs.join(keep.where("not again").select("doc_id"), "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
    again = keep.where("again").select("doc_id")
    if again.isEmpty():
        return once
    nth = unused(docs, "_nth")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in docs.columns)))
    first = docs.join(again, "doc_id", "left_semi").withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return once.unionByName(first.select(*docs.columns))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit fingerprints of all documents and the groups that two bits of difference link: see near_duplicates()."""
    rows = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")
