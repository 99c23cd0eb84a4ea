"""Token alignment of two tokenizers, and how often their ids are linked over a corpus.

Both tokenizers cut a text's bytes.  Tokens whose bytes overlap are linked; where tokens of
both end, a group of tokens ends.  How many documents link a pair of ids is counted in
dense matrices: ids of the first tokenizer are dealt in stripes, a stripe's block has a
row for each of its ids and a column for each id of the second, counts are added into it
by place, and the largest number of a row tells the best partners.  Links are then scored
where their stripe's block is.

A task hands links on in chunks of documents: a row for each stripe with the chunk's
links packed as numbers.  Blocks are filled and read as rows stream by, so that memory is a
block's whatever the corpus; a stripe with many links is read by several tasks, each with
a copy of its counts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphrake.llm.common import materialize, table
from glyphrake.llm.packing import LONG_TEXT, encoder

#: Stripes of the first tokenizer's ids, tasks that add up a stripe first, characters and documents of a chunk, bytes of a stripe's links that one task scores.
STRIPES, FIRST_SUMS, CHUNK_CHARS, CHUNK_DOCUMENTS, SCORED_BYTES = 96, 8, 2_000_000, 4_000, 64_000_000
#: Different links of a chunk in a row at most; pairs that a worker counts before it hands them on.
ROW_LINKS, COUNTED = 1 << 19, 4_000_000
#: The second tokenizer's sign for a blank.
BLANK = "▁"


@dataclass(frozen=True)
class Files:
    """The first tokenizer, its vocabulary as ranks, and the second's model."""

    first: str
    ranks: str
    second: str


def tokenizer_files() -> Files:
    import public_tokenizers as P

    return Files(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model"))


class Tokenizers:
    """Ids of both tokenizers and the bytes of every id; no text is taken for a special token."""

    def __init__(self, files: Files):
        import sentencepiece
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(files.first)
        self.plain.encode_special_tokens = True
        self.fast = encoder((files.first, files.ranks)).fast
        self.second = sentencepiece.SentencePieceProcessor(model_file=files.second)
        with open(files.ranks, "rb") as lines:
            ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        size = self.plain.get_vocab_size()
        self.first_bytes = [ranks.get(i, (self.plain.id_to_token(i) or "").encode()) for i in range(size)]
        self.second_bytes = [self._piece(i) for i in range(self.second.get_piece_size())]
        self.lengths = [np.array([len(x) for x in own], np.int64) for own in (self.first_bytes, self.second_bytes)]
        # decimal ids with what may follow them: one of the same side, or the end of the side's share of a group
        self.names = [np.array([f"{i}{end}" for end in (",", last) for i in range(len(own))], object) for own, last in ((self.first_bytes, "|"), (self.second_bytes, ";"))]

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace(BLANK, " ").encode()

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text by both; None where the text is empty or either's bytes are not those of a blank and the text."""
        if not text:
            return None
        whole = " " + text
        first = np.array(self.plain.encode(whole, add_special_tokens=False).ids if len(whole) >= LONG_TEXT else self.fast.encode_to_numpy(whole), np.int64)
        second = np.array(self.second.encode(text), np.int64)
        raw = whole.encode()
        if b"".join(map(self.first_bytes.__getitem__, first.tolist())) != raw or b"".join(map(self.second_bytes.__getitem__, second.tolist())) != raw:
            return None
        return first, second


_TOKENIZERS: dict[Files, Tokenizers] = {}


def tokenizers(files: Files) -> Tokenizers:
    """One pair per worker process and files."""
    if files not in _TOKENIZERS:
        _TOKENIZERS[files] = Tokenizers(files)
    return _TOKENIZERS[files]


class Aligned:
    """The alignment of some documents' tokens, which stand one document after the other.

    first and second are the links' ids, document their document's number; the rest is per
    document.  Between two neighbouring ends of tokens there is one token of each side, so
    that links and those stretches are the same.
    """

    def __init__(self, own: Tokenizers, ids: list[tuple[np.ndarray, np.ndarray]]):
        sides = [np.concatenate([np.zeros(0, np.int64), *(x[s] for x in ids)]) for s in (0, 1)]
        ends = [np.cumsum(length[side]) for length, side in zip(own.lengths, sides)]
        sizes = [np.fromiter((len(x[s]) for x in ids), np.int64, len(ids)) for s in (0, 1)]
        last = ends[0][np.cumsum(sizes[0]) - 1] if ids else np.zeros(0, np.int64)
        every = np.union1d(*ends)
        self.first, self.second = (side[np.searchsorted(end, every)] for side, end in zip(sides, ends))
        self.document = np.searchsorted(last, every)
        common = np.intersect1d(*ends, assume_unique=True)
        self.n_links, self.n_groups = (np.bincount(np.searchsorted(last, x), minlength=len(ids)) for x in (every, common))
        self.n_first, self.n_second = sizes
        # tokens in the order in which groups list them: a group's of the first side, then its of the second
        groups = [np.searchsorted(common, end) for end in ends]
        before = [np.concatenate(([0], np.cumsum(np.bincount(g, minlength=len(common))))) for g in groups]
        listed = np.empty(len(sides[0]) + len(sides[1]), object)
        for s, shift in ((0, before[1][groups[0]]), (1, before[0][groups[1] + 1])):
            closes = np.append(groups[s][1:] != groups[s][:-1], True)[: len(groups[s])]
            listed[np.arange(len(sides[s])) + shift] = own.names[s][sides[s] + closes * len(own.lengths[s])]
        bounds = np.concatenate(([0], np.cumsum(sizes[0] + sizes[1]))).tolist()
        self.groups = ("".join(listed[a:b].tolist())[:-1] for a, b in zip(bounds, bounds[1:]))


LINKS = "chunk long, stripe int, document int, doc_id long, n_first long, n_second long, n_groups long, n_links long, groups_sha256 string, documents binary, pairs binary, times binary"
DOCUMENT = ("chunk", "document", "doc_id", "n_first", "n_second", "n_groups", "n_links", "groups_sha256")
TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _rows(**columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    fields = [x.split() for x in LINKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * n), TYPES[kind]) for name, kind in fields], names=[name for name, _ in fields])


def document_links(docs: DataFrame, files: Files, stripes: int = STRIPES) -> DataFrame:
    """Two kinds of rows: a row for each document (DOCUMENT), and rows with stripe, documents, pairs and times.

    documents, pairs and times have an entry for every different pair that a document
    links: its number in the chunk (16 bits), the pair's place in the stripe's block and how
    many links it has (32 bits each).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk = tokenizers(files), TaskContext.get().partitionId() << 32
        width = len(own.second_bytes)

        def out(held: list[tuple[int | None, tuple | None]]) -> Iterator[pa.RecordBatch]:
            there = [i for i, (_, ids) in enumerate(held) if ids is not None]
            found = Aligned(own, [held[i][1] for i in there])
            counts = {name: np.zeros(len(held), np.int64) for name in ("n_first", "n_second", "n_groups", "n_links")}
            for name, column in counts.items():
                column[there] = getattr(found, name)
            digests = [""] * len(held)
            for i, groups in zip(there, found.groups):
                digests[i] = hashlib.sha256(groups.encode()).hexdigest()
            yield _rows(chunk=[chunk] * len(held), document=list(range(len(held))), doc_id=[i for i, _ in held], groups_sha256=digests, **counts)
            # stripe, document and place in one number
            key = (found.first % stripes) << 48 | np.array(there, np.int64)[found.document] << 32 | (found.first // stripes) * width + found.second
            key, times = np.unique(key, return_counts=True)
            stripe = key >> 48
            cuts = np.flatnonzero(np.concatenate(([True], stripe[1:] != stripe[:-1])))[: len(key)].tolist()
            cuts = sorted({*cuts, *range(0, len(key), ROW_LINKS), len(key)})
            parts = list(zip(cuts, cuts[1:]))
            packed = {"documents": (key >> 32 & 0xFFFF).astype("<u2"), "pairs": (key & 0xFFFFFFFF).astype("<u4"), "times": times.astype("<u4")}
            if parts:
                yield _rows(chunk=[chunk] * len(parts), stripe=[int(stripe[a]) for a, _ in parts], **{name: [x[a:b].tobytes() for a, b in parts] for name, x in packed.items()})

        held, chars = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                held.append((doc_id, own.ids(text)))
                chars += len(text)
                if chars >= CHUNK_CHARS or len(held) >= CHUNK_DOCUMENTS:
                    yield from out(held)
                    held, chars, chunk = [], 0, chunk + 1
        if held:
            yield from out(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, LINKS)


COUNTS = "stripe int, pairs binary, counts binary"


def _packed(stripe: int, pairs: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([pairs.astype("<u4").tobytes()]), pa.array([counts.astype("<i8").tobytes()])], names=["stripe", "pairs", "counts"])


def _read(row: pa.RecordBatch, i: int, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(row.column(name)[i].as_buffer(), kind)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each pair among some links: what a task has of a stripe, added up before it is sent anywhere."""
    held: list[np.ndarray] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        edges = np.searchsorted(key >> 32, np.arange((int(key[-1]) >> 32) + 2))
        for stripe, (a, b) in enumerate(zip(edges.tolist(), edges[1:].tolist())):
            if a < b:
                yield _packed(stripe, key[a:b] & 0xFFFFFFFF, n[a:b])

    for batch in batches:
        for i, stripe in enumerate(batch.column("stripe").to_pylist()):
            held.append(stripe << 32 | _read(batch, i, "pairs", "<u4").astype(np.int64))
            size += len(held[-1])
            if size >= COUNTED:
                yield from out()
                held, size = [], 0
    if size:
        yield from out()


def _summed(cells: int):
    """Adds the counts of a stripe into its block, one stripe after the other, and packs what is not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, stripe = None, None

        def out() -> pa.RecordBatch:
            pairs = np.flatnonzero(block)
            return _packed(stripe, pairs, block[pairs])

        for batch in batches:
            for i, own in enumerate(batch.column("stripe").to_pylist()):
                if own != stripe:
                    if block is not None:
                        yield out()
                    block, stripe = np.zeros(cells, np.int64), own
                np.add.at(block, _read(batch, i, "pairs", "<u4"), _read(batch, i, "counts", "<i8"))
        if block is not None:
            yield out()

    return run


def stripe_counts(links: DataFrame, cells: int) -> DataFrame:
    """stripe, pairs, counts: a row for each stripe with the documents of all its pairs.

    Tasks count their links, then FIRST_SUMS tasks add up shares of a stripe, then one adds
    up those: what reaches it has an entry for each different pair and share.
    """
    own = links.where("stripe is not null").select("stripe", "pairs")
    # the share follows from the row, so that a task that runs again deals as before
    share = F.pmod(F.xxhash64("pairs"), F.lit(FIRST_SUMS))
    some = own.mapInArrow(_counted, COUNTS).repartition("stripe", share).sortWithinPartitions("stripe").mapInArrow(_summed(cells), COUNTS)
    return some.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(_summed(cells), COUNTS)


def pair_counts(counts: DataFrame, width: int, stripes: int = STRIPES) -> DataFrame:
    """first, second, documents, best of every linked pair of ids; best: no other partner of first is in more documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, stripe in enumerate(batch.column("stripe").to_pylist()):
                pairs, n = _read(batch, i, "pairs", "<u4").astype(np.int64), _read(batch, i, "counts", "<i8")
                row = pairs // width
                most = np.zeros(int(row.max(initial=0)) + 1, np.int64)
                np.maximum.at(most, row, n)
                columns = (row * stripes + stripe, pairs % width, n, n == most[row])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["first", "second", "documents", "best"])

    return counts.mapInArrow(run, "first long, second long, documents long, best boolean")


SCORES = "chunk long, documents binary, best binary, total binary"


def _scored(cells: int, width: int):
    """Links of a stripe against its block: in each document, links with a best partner and the sum of the links' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = most = None
        for batch in batches:
            rows = []
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                pairs = _read(batch, i, "pairs", "<u4")
                if chunk is None:  # the stripe's counts come before its links
                    block = np.zeros(cells, np.int64)
                    np.add.at(block, pairs, _read(batch, i, "counts", "<i8"))
                    most = block.reshape(-1, width).max(axis=1)
                    continue
                times, documents = _read(batch, i, "times", "<u4").astype(np.int64), _read(batch, i, "documents", "<u2")
                n = block[pairs]
                # links of a row stand by document
                heads = np.flatnonzero(np.concatenate(([True], documents[1:] != documents[:-1])))
                best, total = (np.add.reduceat(x, heads) for x in (times * (n == most[pairs // width]), times * n))
                rows.append((chunk, documents[heads].tobytes(), best.astype("<u4").tobytes(), total.astype("<i8").tobytes()))
            if rows:
                chunks, *packed = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], names=["chunk", "documents", "best", "total"])

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scores of a chunk's documents, from rows in order of chunks."""
    sums, chunk = None, None

    def out() -> pa.RecordBatch:
        there = np.flatnonzero(sums[0] + sums[1])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(there), chunk)), pa.array(there.astype(np.int32)), pa.array(sums[0][there]), pa.array(sums[1][there])], names=["chunk", "document", "n_best", "count_sum"])

    for batch in batches:
        for i, own in enumerate(batch.column("chunk").to_pylist()):
            if own != chunk:
                if sums is not None:
                    yield out()
                sums, chunk = np.zeros((2, 1 << 16), np.int64), own
            documents = _read(batch, i, "documents", "<u2")
            for k, (name, kind) in enumerate((("best", "<u4"), ("total", "<i8"))):
                np.add.at(sums[k], documents, _read(batch, i, name, kind))
    if sums is not None:
        yield out()


def _table_of(numbers: dict[int, int], key: Column) -> Column:
    """The number of a key, from a few."""
    return F.element_at(F.create_map(*(F.lit(x).cast("int") for pair in numbers.items() for x in pair)), key)


def scored_links(links: DataFrame, counts: DataFrame, cells: int, width: int) -> DataFrame:
    """chunk, document, n_best, count_sum of documents with links.

    Links and counts are brought together by stripe.  A stripe with more than SCORED_BYTES
    of links goes to several tasks by chunk, each of which gets its counts.
    """
    own = links.where("stripe is not null").select("stripe", "chunk", "documents", "pairs", "times")
    sizes = {r["stripe"]: r["size"] for r in own.groupBy("stripe").agg(F.sum(F.octet_length("pairs") + F.octet_length("documents") + F.octet_length("times")).alias("size")).collect()}
    if not sizes:
        return links.select("chunk", "document", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum")).limit(0)
    shares, first, parts = {}, {}, 0
    for stripe, size in sorted(sizes.items()):
        shares[stripe], first[stripe] = -(-size // SCORED_BYTES), parts
        parts += shares[stripe]
    begin, share = _table_of(first, F.col("stripe")), _table_of(shares, F.col("stripe"))
    sent = own.withColumns({"part": (begin + F.pmod(F.xxhash64("chunk"), share)).cast("int"), "counts": F.lit(None).cast("binary")})
    copies = counts.select("stripe", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("documents"), "pairs", F.lit(None).cast("binary").alias("times"), F.explode(F.sequence(begin, begin + share - 1)).alias("part"), "counts")
    together = sent.select(copies.columns).unionByName(copies).repartition("part").sortWithinPartitions("part", F.asc_nulls_first("chunk"))
    scores = together.select("chunk", "documents", "pairs", "times", "counts").mapInArrow(_scored(cells, width), SCORES)
    return scores.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_by_document, "chunk long, document int, n_best long, count_sum long")


def align(docs: DataFrame, files: Files | None = None, stripes: int = STRIPES) -> tuple[DataFrame, DataFrame]:
    """Documents and pairs of ids.

    Documents: doc_id, n_first, n_second (tokens), n_groups, n_links, n_best (links whose
    pair is in as many documents as any of its first id), count_sum (the documents of the
    pairs, over all links), groups_sha256.  Pairs: see pair_counts().

    Null and empty texts, and those that a tokenizer does not give back byte by byte, have
    no tokens: zeros and ''.  Repeated rows and ids are documents of their own; null ids are
    kept; other columns are not read; an empty table gives no rows.
    """
    files = files or tokenizer_files()
    own = tokenizers(files)
    width, cells = len(own.second_bytes), -(-len(own.first_bytes) // stripes) * len(own.second_bytes)
    links = materialize(document_links(docs, files, stripes), "align-links")
    counts = materialize(stripe_counts(links, cells), "align-counts")
    scores = scored_links(links, counts, cells, width)
    documents = links.where("stripe is null").select(*DOCUMENT).join(scores, ["chunk", "document"], "left")
    documents = documents.select(*DOCUMENT[2:7], *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
    return documents, pair_counts(counts, width, stripes)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned: see align()."""
    documents, _ = align(table(spark, sf_dir, "documents", "doc_id", "text"))
    return documents.withColumnsRenamed({"n_first": "n_a", "n_second": "n_b"})
