"""Substring deduplication by seed and extend.

Seeds are winnowed word n-grams: every window of the threshold's length selects the
n-gram with the smallest hash in it, so that equal windows select equal seeds.
Documents meet on seeds.  A seed is extended both ways to the span of all windows that
select it, and spans are compared as wholes; only where the spans around a shared seed
differ are their windows compared one by one.  Windows found in an earlier document
join into maximal repeats, whose words go.

Nothing is paired: each seed, span and window is reduced to the smallest document that
has it, whatever the number of copies, and joined back to its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphrake.llm.common import materialize, pieces_of, table

#: Words of a window, words of a seed, characters hashed at a time.
WINDOW, SEED_WORDS, CHARS = 50, 12, 2_000_000
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2^64
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0 .. n - 1, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Windows:
    """Windows, seeds and spans of some documents' words.

    first: the place of each window's first word; doc: its document.  span_of numbers
    the spans, runs of neighbouring windows of one document that select the same seed.
    """

    def __init__(self, words: Sequence[Sequence[bytes]], window: int = WINDOW, seed_words: int = SEED_WORDS):
        counts = np.fromiter(map(len, words), np.int64, len(words))
        self.begin = np.concatenate(([0], np.cumsum(counts)))
        total = int(self.begin[-1])
        digest = xxhash.xxh64_intdigest
        codes = np.fromiter((digest(w) for own in words for w in own), np.uint64, total)
        power, self._inverse = _powers(total + 1)
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * power[:total], dtype=np.uint64)))
        inside = np.maximum(counts - window + 1, 0)
        self.doc = np.repeat(np.arange(len(words)), inside)
        self.first = np.arange(len(self.doc)) - np.repeat(np.cumsum(inside) - inside, inside) + self.begin[self.doc]
        self._window = window
        if not len(self.first):
            self.seed = self.span = np.zeros(0, np.uint64)
            self.span_of, self.span_doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        least = _mix(self._hash(np.arange(total - seed_words + 1), seed_words))
        reach, width = window - seed_words + 1, 1
        while width * 2 <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < reach:
            least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        chosen = least[self.first]
        change = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (self.doc[1:] != self.doc[:-1])))
        self.span_of = np.cumsum(change) - 1
        heads = np.flatnonzero(change)
        lengths = np.diff(np.concatenate((heads, [len(change)])))
        self.seed, self.span_doc = chosen[heads], self.doc[heads]
        self.span = _mix(self._hash(self.first[heads], lengths + window - 1) + _mix(lengths.astype(np.uint64)))

    def _hash(self, first: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return (self._sums[first + length] - self._sums[first]) * self._inverse[first]

    def hashes(self, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hashes of windows as signed integers."""
        return _mix(self._hash(self.first[which], self._window)).view(np.int64)

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """Which words the repeated windows cover."""
        marks = np.zeros(int(self.begin[-1]) + 1, np.int64)
        np.add.at(marks, self.first[repeated], 1)
        np.add.at(marks, self.first[repeated] + self._window, -1)
        return np.cumsum(marks)[:-1] > 0


def _words(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII blanks (bytes split on just those)."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str]]]:
    texts = [x or "" for x in batch.column(column).to_pylist()]
    for begin, end in pieces_of(texts, CHARS):
        yield begin, end, texts[begin:end]


def _seeds(docs: DataFrame, window: int, seed_words: int) -> DataFrame:
    """(seed, span, doc_id): a row for every span of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in _parts(batch, 1):
                found = Windows([_words(x) for x in texts], window, seed_words)
                ids = batch.column(0).slice(begin, end - begin).take(pa.array(found.span_doc))
                yield pa.RecordBatch.from_arrays([pa.array(found.seed.view(np.int64)), pa.array(found.span.view(np.int64)), ids], names=["seed", "span", "doc_id"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "seed long, span long, doc_id long")


def _contested(docs: DataFrame, window: int, seed_words: int) -> DataFrame:
    """(hash, doc_id) of the windows in the listed spans of each document (doc_id, text, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            for begin, end, texts in _parts(batch, 1):
                found = Windows([_words(x) for x in texts], window, seed_words)
                wanted = _listed(found.span.view(np.int64), found.span_doc, spans[begin:end])
                which = np.flatnonzero(wanted[found.span_of])
                ids = batch.column(0).slice(begin, end - begin).take(pa.array(found.doc[which]))
                yield pa.RecordBatch.from_arrays([pa.array(found.hashes(which)), ids], names=["hash", "doc_id"])

    return docs.select("doc_id", "text", "spans").mapInArrow(run, "hash long, doc_id long")


def _listed(values: np.ndarray, doc: np.ndarray, lists: Sequence[list[int] | None]) -> np.ndarray:
    """Whether each value is in the list of its document."""
    out = np.zeros(len(values), bool)
    edges = np.searchsorted(doc, np.arange(len(lists) + 1))
    for i, own in enumerate(lists):
        if own:
            out[edges[i] : edges[i + 1]] = np.isin(values[edges[i] : edges[i + 1]], np.array(own, np.int64))
    return out


def _earlier(rows: DataFrame, key: str) -> DataFrame:
    """(doc_id, key) of the rows whose key a smaller document has, too.

    The first documents are a table of their own: the join then has two plain exchanges,
    and Spark can split a key that very many documents have.
    """
    least = rows.groupBy(key).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select(key, "first_id")
    least = materialize(least, "repeat-first")
    return rows.join(least, key).where("doc_id > first_id").select("doc_id", key)


def repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """(doc_id, text, spans, windows, ...): docs with what earlier documents have of theirs, as hashes."""
    rows = materialize(_seeds(docs, window, seed_words), "repeat-seeds")
    # seeds that only one document has can't lead anywhere
    shared = rows.groupBy("seed").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), (F.min("span") < F.max("span")).alias("contested")).where("first_id < last_id").select("seed", "contested")
    shared = materialize(shared, "repeat-shared")
    spans = materialize(rows.join(shared, "seed").select("span", "contested", "doc_id").distinct(), "repeat-spans")
    whole = _earlier(spans.select("span", "doc_id"), "span").groupBy("doc_id").agg(F.collect_set("span").alias("spans"))
    # one document stands for all that have a contested span: the first
    stand_in = spans.where("contested").groupBy("span").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_set("span").alias("spans"))
    windows = materialize(_contested(docs.select("doc_id", "text").join(stand_in, "doc_id"), window, seed_words).distinct(), "repeat-windows")
    single = _earlier(windows, "hash").groupBy("doc_id").agg(F.collect_set("hash").alias("windows"))
    found = whole.join(single, "doc_id", "full_outer").withColumnRenamed("doc_id", "found_id")
    return docs.join(found, F.col("doc_id") == F.col("found_id"), "left").drop("found_id")


def _removed(texts: Sequence[str], spans: Sequence, windows: Sequence, window: int, seed_words: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, the place where each text's words begin, and which of all words go."""
    words = [_words(x) for x in texts]
    found = Windows(words, window, seed_words)
    repeated = _listed(found.span.view(np.int64), found.span_doc, spans)[found.span_of] if len(found.first) else np.zeros(0, bool)
    if any(windows):
        rest = np.flatnonzero(~repeated)
        repeated[rest] = _listed(found.hashes(rest), found.doc[rest], windows)
    return words, found.begin, found.covered(np.flatnonzero(repeated))


OUT = ("text_kept", "n_words", "n_removed", "kept_sha256")


def _rewritten(docs: DataFrame, window: int, seed_words: int, texts_out: bool = True) -> DataFrame:
    """doc_id, text, rest (a struct of the other columns) and OUT, whatever the other columns are called.

    Without texts_out text_kept is null: nothing is rebuilt that nobody reads.
    """
    rest = F.struct(F.lit(0).alias("_0"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    prepared = repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("rest")), window, seed_words).select("doc_id", "text", "spans", "windows", "rest")
    out_schema = prepared.select("doc_id", "text", "rest").schema.add("text_kept", "string").add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, windows, kept_texts, counts, removed, digests = batch.column(2).to_pylist(), batch.column(3).to_pylist(), [], [], [], []
            for begin, end, texts in _parts(batch, 1):
                words, places, gone = _removed(texts, spans[begin:end], windows[begin:end], window, seed_words)
                for text, own, at, to in zip(texts, words, places[:-1].tolist(), places[1:].tolist()):
                    drop = gone[at:to]
                    n = int(drop.sum())
                    kept = own if not n else [w for w, d in zip(own, drop.tolist()) if not d]
                    counts.append(len(own))
                    removed.append(n)
                    digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    kept_texts.append(None if not texts_out else text if not n else _cut(text, own, drop))
            rebuilt = pa.array([new if there else None for there, new in zip(batch.column(1).is_valid().to_pylist(), kept_texts)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), rebuilt, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=out_schema.names)

    return prepared.mapInArrow(run, out_schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed_words: int = SEED_WORDS) -> DataFrame:
    """docs with text_kept, the text without repeated words, n_words, n_removed and kept_sha256.

    A word goes if a window of window words that covers it also starts in a document
    with a smaller doc_id; windows are those of the input.  Kept words stand as they
    were, with the blanks after them.  Null texts have no words and stay null; short
    texts have no windows.  Rows with a null doc_id are neither earlier nor later than
    others and keep all words.  Rows that repeat an id are compared with other ids only.
    Other columns pass through, but for columns of the same names as the new ones.
    """
    rows = _rewritten(docs, window, seed_words)
    return rows.select(*(F.col(f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in OUT), *OUT)


def _cut(text: str, words: Sequence[bytes], drop: np.ndarray) -> str:
    """The text without the dropped words and the blanks after them."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    begin = 0
    for word, gone in zip(words, drop.tolist()):
        place = raw.index(word, at)
        if gone:
            out.append(raw[begin:place])
            at = begin = place + len(word)
            while begin < len(raw) and raw[begin] in b" \t\n\r\x0b\x0c":
                begin += 1
        else:
            at = place + len(word)
    out.append(raw[begin:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated words taken out of text and n_chars set anew; documents of which nothing is left go.

    Documents without repeats keep their text as it is; those without words stay.
    """
    rows = _rewritten(docs, options.get("window", WINDOW), options.get("seed_words", SEED_WORDS)).where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    new = {"text": F.col("text_kept"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("text_kept").cast("long"))}
    return rows.select(*(F.coalesce(new[c], F.col(f"rest.c{i}")).alias(c) if c in new else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, those that earlier documents have in windows of 50, and a digest of the rest: see remove_repeats()."""
    return _rewritten(table(spark, sf_dir, "documents", "doc_id", "text"), WINDOW, SEED_WORDS, texts_out=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
