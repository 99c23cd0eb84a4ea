"""I-Match fingerprints over randomised lexicons.

The lexicon is every term whose document frequency lies in a band: frequent enough to
be no accident, rare enough to tell documents apart.  A document's distinct terms in
the lexicon, sorted, are hashed; so are those in each of several random subsets of the
lexicon.  A change to the text spares the subsets in which no term changed.  Subsets
come in sizes from a quarter of the lexicon down, so that short and long documents
alike have subsets with a few of their terms.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphrake.llm.common import materialize, table

#: Share of documents that a term of the lexicon is in, at least and at most, and the least number of documents.
LEAST_SHARE, MOST_SHARE, LEAST_DOCUMENTS = 1e-4, 0.05, 2
#: Subsets, and the shares of the lexicon that they have, dealt in turn.
SUBSETS, SHARES = 64, tuple(2.0**-i for i in range(2, 13))
#: Terms that a worker counts or remembers before it starts anew, documents in a range of ids, and most ranges.
REMEMBERED, RANGE, MOST_RANGES = 250_000, 1_500, 65_536
#: Rows that a worker hands on at a time, and ranges of documents without an id.
HANDED_ON, UNPLACED = 500, 256
#: Terms of a lexicon that are sent to all tasks, the most frequent ones, 16 bytes each; the others are joined.
MOST_TERMS = 4_000_000
TERM = re.compile(r"\w+")


def _terms(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


def _term_hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"))


@dataclass(frozen=True)
class Lexicon:
    """sent: sorted hashes of the most frequent terms of the band; rest: the other terms' hashes (term BIGINT), or none."""

    sent: np.ndarray
    rest: DataFrame | None = None


def lexicon(docs: DataFrame, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE) -> Lexicon:
    """The terms in the band, from the document frequencies of all documents.

    A term needs least_share of the documents, so the lexicon has at most 1 / least_share
    times as many terms as a document has on average, at any number of documents.  Where
    that is above MOST_TERMS, the most frequent terms are sent and the others stay a table;
    fingerprints are the same whatever is sent.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            hashes = np.fromiter(map(_term_hash, found), np.uint64, len(found)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0):
                found.update(_terms(text.as_py() or ""))
                if len(found) > 2 * REMEMBERED:
                    yield out()
                    found.clear()
        yield out()

    n = docs.count()
    least, most = max(LEAST_DOCUMENTS, least_share * n), max(LEAST_DOCUMENTS, most_share * n)
    sums = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = materialize(sums.where((F.col("n") >= least) & (F.col("n") <= most)), "imatch-band")
    if band.count() <= MOST_TERMS:
        kept, rest = band, None
    else:
        # the frequency from which on few enough terms are left
        by_size = {r["n"]: r["count"] for r in band.groupBy("n").count().orderBy(F.desc("n")).limit(max(MOST_TERMS, 1)).collect()} if MOST_TERMS else {}
        edge, held = None, 0
        for n_, terms in sorted(by_size.items(), reverse=True):
            held += terms
            if held > MOST_TERMS:
                break
            edge = n_
        frequent = F.col("n") >= edge if edge is not None else F.lit(False)
        kept, rest = band.where(frequent), band.where(~frequent).select("term")
    return Lexicon(np.sort(kept.select("term").toArrow().column("term").to_numpy().view(np.uint64)), rest)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def memberships(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit mask for each term: the subsets that have it."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(SUBSETS):
        drawn = _mix(hashes ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) < np.uint64(int(SHARES[k % len(SHARES)] * 2**64))
        out |= drawn.astype(np.uint64) << np.uint64(k)
    return out


class Printer:
    """Fingerprints texts; remembers the places of terms in the lexicon.

    more: further terms of the lexicon, which the texts at hand may have.
    """

    def __init__(self, terms: np.ndarray, masks: np.ndarray):
        self.terms, self.masks, self.known = terms, masks, {}
        self.more = self.more_masks = np.zeros(0, np.uint64)
        self.bits = (np.uint64(1) << np.arange(SUBSETS, dtype=np.uint64))[:, None]

    def take(self, more: np.ndarray) -> None:
        self.more, self.more_masks = more, memberships(more)
        self.known.clear()

    def _look_up(self, new: list[str]) -> None:
        hashes, found = np.fromiter(map(_term_hash, new), np.uint64, len(new)), np.full(len(new), -1)
        for begin, terms in ((0, self.terms), (len(self.terms), self.more)):
            if len(terms):
                at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                found = np.where(terms[at] == hashes, at + begin, found)
        self.known.update(zip(new, found.tolist()))

    def unknown(self, text: str) -> np.ndarray:
        """Hashes of the text's terms that are not in the lexicon so far."""
        words = _terms(text)
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) > REMEMBERED:
                self.known.clear()
                new = list(words)
            self._look_up(new)
        return np.fromiter((_term_hash(w) for w in words if self.known[w] < 0), np.uint64)

    def _lexicon_terms(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and masks of the text's terms in the lexicon; of all its terms if it has none of them."""
        words, known = _terms(text), self.known
        new = [w for w in words if w not in known]
        if new:
            if len(known) > REMEMBERED:
                known.clear()
                new = list(words)
            self._look_up(new)
        places = set(map(known.__getitem__, words))
        places.discard(-1)
        if places:
            at = np.array(sorted(places))
            if at[-1] < len(self.terms):
                return self.terms[at], self.masks[at]
            own, further = at[at < len(self.terms)], at[at >= len(self.terms)] - len(self.terms)
            hashes, masks = np.concatenate((self.terms[own], self.more[further])), np.concatenate((self.masks[own], self.more_masks[further]))
            order = np.argsort(hashes)
            return hashes[order], masks[order]
        hashes = np.array(sorted(map(_term_hash, words)), np.uint64)
        return hashes, memberships(hashes)

    def fingerprint(self, text: str) -> str:
        """16 digits for the whole lexicon, 4 for each subset; zeros where there is no term."""
        hashes, masks = self._lexicon_terms(text)
        if not len(hashes):
            return "0" * (16 + 4 * SUBSETS)
        subset, term = np.nonzero(masks[None, :] & self.bits)
        ends = (8 * np.cumsum(np.bincount(subset, minlength=SUBSETS))).tolist()
        raw, digest, begin = hashes[term].astype("<u8").tobytes(), xxhash.xxh64_intdigest, 0
        out = [f"{digest(hashes.astype('<u8').tobytes()):016x}"]
        for end in ends:
            out.append(f"{digest(raw[begin:end]) % 65_535 + 1:04x}" if end > begin else "0000")
            begin = end
        return "".join(out)


def likeness(a: str, b: str) -> float:
    """The share of subsets with terms of either text that have the same terms of both; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(f[16:].encode("ascii"), "S4") for f in (a, b))
    same, either = (x == y), (x != b"0000") | (y != b"0000")
    return float((same & either).sum() / either.sum()) if either.any() else 0.0


def in_id_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, place, extra: ranges of descending ids, each followed by the document that comes next.

    Rows are dealt by range of ids, in order within it; the first document of the next
    range (of the first range for the last) comes along as an extra row.  Bounds come
    from quantiles, and the driver holds two numbers for each of MOST_RANGES ranges at
    most.  A range is sorted on disk and read from there in order, so that its size needs
    no memory.  Rows with a null id are in no range.
    """
    ids = docs.where("doc_id is not null").select("doc_id")
    n = ids.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE))
    cuts = sorted({float(x) for x in ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], max(20_000, 4 * ranges))).first()[0]}) if ranges > 1 else []
    keyed = docs.where("doc_id is not null").withColumn("id_number", F.col("doc_id").cast("double"))

    def ranged(df: DataFrame) -> DataFrame:
        if not cuts:
            return df.withColumn("place", F.lit(0)).drop("id_number")
        bucketed = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="id_number", outputCol="place").transform(df)
        return bucketed.withColumn("place", F.col("place").cast("int")).drop("id_number")

    tops = sorted((r["place"], r["top"]) for r in ranged(ids.withColumn("id_number", F.col("doc_id").cast("double"))).groupBy("place").agg(F.max("doc_id").alias("top")).collect())
    follows = [(tops[i - 1][1], place) for i, (place, _) in enumerate(tops)]  # what is before the lowest range wraps around
    halo = docs.sparkSession.createDataFrame(follows, "top long, goes_to int")
    rows = ranged(keyed).join(F.broadcast(halo), F.col("doc_id") == F.col("top"), "left")
    there = F.array(F.struct("place", F.lit(0).alias("extra")), F.struct(F.col("goes_to").alias("place"), F.lit(1).alias("extra")))
    rows = rows.select("doc_id", "text", F.explode(there).alias("there")).select("doc_id", "text", "there.place", "there.extra").where("place is not null")
    return rows.repartitionById(ranges, "place").sortWithinPartitions("place", "extra", F.desc("doc_id"), F.xxhash64("text"))


def _edited(text: str, following: str | None) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + (following or "")[:half]


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, int, int, bytes | None]]:
    """doc_id, text, place, extra and terms of each row."""
    for batch in batches:
        terms = batch.column(4).to_pylist() if batch.num_columns > 4 else [None] * batch.num_rows
        for doc_id, text, place, extra, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), terms):
            yield doc_id, text.as_py() or "", place, extra, own


def _terms_of_ranges(rows: DataFrame, words: Lexicon) -> DataFrame:
    """place, terms: the terms of the lexicon's rest that texts or edited texts of a range of documents have, packed."""
    shared = rows.sparkSession.sparkContext.broadcast(Printer(words.sent, np.zeros(len(words.sent), np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer, held, found, at = shared.value, None, [], None

        def out() -> pa.RecordBatch:
            terms = np.unique(np.concatenate(found)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), at, np.int32)), pa.array(terms)], names=["place", "term"])

        for doc_id, text, place, extra, _ in _in_turn(batches):
            if place != at or sum(map(len, found)) > REMEMBERED:
                if found:
                    yield out()
                found, at = [], place
            if held and held[1] == place and not held[2]:
                found.append(printer.unknown(_edited(held[0], text)))
            if doc_id is None:
                found.append(printer.unknown(_edited(text, None)))
            found.append(printer.unknown(text))
            held = (text, place, extra or doc_id is None)
        if found:
            yield out()

    asked = rows.mapInArrow(run, "place int, term long").distinct()
    there = asked.join(words.rest, "term").groupBy("place").agg(F.collect_list("term").alias("found"))
    return materialize(there, "imatch-ranges").select("place", F.col("found").alias("terms"))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, words: Lexicon) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    The edited text has the last half of the characters replaced by as many of the next
    document (by descending id; the first after the last; among equal ids by text hash).
    A text without any term of the lexicon is known by all its terms, so that short texts
    have fingerprints at all; one term of the lexicon put into such a text changes it whole.
    Null texts count as empty.  Rows with a null id have no next document: their edited
    text lacks the second half and near_next is 0.  The only row follows itself.

    Where a part of the lexicon stays a table, each range of documents is told first which
    of its terms are there: that takes one more pass over the texts, and as many terms as a
    range of documents has stand before its documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Printer(words.sent, memberships(words.sent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer, held, rows = shared.value, None, []  # a worker keeps what the printer has looked up
        if len(printer.more):
            printer.take(np.zeros(0, np.uint64))
        told = None

        def finish(row: tuple, following: str | None, next_print: str | None) -> None:
            doc_id, text, _, _, own = row
            edited = _edited(text, following)
            edited_print = own if edited == text else printer.fingerprint(edited)
            rows.append((doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, edited_print, likeness(own, edited_print), likeness(own, next_print) if next_print else 0.0))

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x) if i > 1 else pa.array(x, pa.int64()) for i, x in enumerate(zip(*rows))], names=[x.split()[0] for x in OUT.split(", ")])
            rows.clear()
            return batch

        for doc_id, text, place, extra, terms in _in_turn(batches):
            if terms is not None:  # the range's terms stand before its documents
                printer.take(np.sort(np.array(terms, np.int64).view(np.uint64)))
                told = place
                continue
            if told is not None and place != told:
                printer.take(np.zeros(0, np.uint64))
                told = None
            if doc_id is None:
                finish((None, text, place, extra, printer.fingerprint(text)), None, None)
            else:
                own = held[4] if held and held[1] == text and held[2] == place else printer.fingerprint(text)
                if held and held[2] == place and not held[3]:
                    finish(held, text, own)
                held = (doc_id, text, place, extra, own)
            if len(rows) >= HANDED_ON:
                yield out()
        if rows:
            yield out()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # documents without an id are ranges by hash, so that any number of them is spread
    unplaced = docs.where("doc_id is null").withColumns({"place": (-1 - F.pmod(F.xxhash64("text"), F.lit(UNPLACED))).cast("int"), "extra": F.lit(0)})
    placed = in_id_order(docs)
    if words.rest is None:
        return placed.mapInArrow(run, OUT).unionByName(unplaced.mapInArrow(run, OUT))
    unplaced = unplaced.repartition("place").sortWithinPartitions("place")
    told = _terms_of_ranges(placed, words).unionByName(_terms_of_ranges(unplaced, words))
    head = told.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "place", F.lit(-1).alias("extra"), "terms")
    every = placed.unionByName(unplaced).withColumn("terms", F.lit(None).cast("array<bigint>")).unionByName(head)
    return every.repartition("place").sortWithinPartitions("place", "extra", F.desc("doc_id"), F.xxhash64("text")).mapInArrow(run, OUT)


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts: see edited_fingerprints()."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return edited_fingerprints(docs, lexicon(docs))
